"""Floating-point expressions that keep IEEE results where ANSI SQL would raise."""

from __future__ import annotations


def ieee_divide(numerator: str, denominator: str) -> str:
    """``x/0`` is signed infinity, ``0/0`` is NaN, null stays null."""
    a, b = f"CAST({numerator} AS double)", f"CAST({denominator} AS double)"
    return f"""CASE WHEN {b} = 0 THEN
        CASE WHEN {a} = 0 OR isnan({a}) THEN double('NaN') WHEN {a} > 0 THEN double('Infinity')
             WHEN {a} < 0 THEN double('-Infinity') END
        ELSE {a} / nullif({b}, 0D) END"""


def min_number(value: str) -> str:
    """Minimum that ignores NaN unless there is nothing else."""
    return f"coalesce(min({value}) FILTER (WHERE NOT isnan({value})), min({value}))"


def max_number(value: str) -> str:
    """Maximum that ignores NaN unless there is nothing else."""
    return f"coalesce(max({value}) FILTER (WHERE NOT isnan({value})), max({value}))"

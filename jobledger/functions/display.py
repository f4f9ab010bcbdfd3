"""Values as the reports show them."""

from __future__ import annotations

from jobledger.schema import EFFICIENCY_BANDS


def band_colour(value: str, bands=EFFICIENCY_BANDS) -> str:
    """Colour of the inclusive band that holds the value.

    Null, 0 and NaN have no colour, nor have values that fall between two integer bands (20.5). Values outside the
    whole scale take the first or last colour.
    """
    (lowest, _, first), (_, highest, last) = bands[0], bands[-1]
    inside = " ".join(f"WHEN {value} BETWEEN {low} AND {high} THEN '{name}'" for low, high, name in bands)
    return f"""CASE WHEN {value} = 0 OR isnan({value}) THEN NULL WHEN {value} < {lowest} THEN '{first}'
        WHEN {value} > {highest} THEN '{last}' {inside} END"""


def duration_label(seconds: str) -> str:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``; ``N/A`` for null."""
    value = f"CAST({seconds} AS double)"
    hours, minutes, rest = f"floor({value} / 3600)", f"floor(pmod({value}, 3600D) / 60)", f"floor(pmod({value}, 60D))"
    return f"""CASE WHEN {value} IS NULL THEN 'N/A'
        WHEN {hours} > 0 THEN format_string('%dh %dm %ds', {hours}, {minutes}, {rest})
        WHEN {minutes} > 0 THEN format_string('%dm %ds', {minutes}, {rest})
        ELSE format_string('%ds', {rest}) END"""


def table_number(value: str) -> str:
    return f"round({value}, 3)"


def legend_number(value: str) -> str:
    return f"round({value}, 2)"


def two_decimals(value: str) -> str:
    """Daily values as text; missing ones show as 0."""
    return f"format_string('%.2f', coalesce(CAST({value} AS double), 0D))"

"""SQL expressions by name: each function takes column names (or SQL text) and returns SQL text.

Use them with ``F.expr``, ``selectExpr`` or inside SQL. Everything is a built-in function, so no Python runs per row.
"""

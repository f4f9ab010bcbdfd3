"""How much code Spark generates in one piece."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(value: Column | str) -> Column:
    """The same value, through a lambda.

    Dozens of columns that are computed together, with all that reads them, become one method of more than 8 000 bytes; the
    JVM does not compile such a method but interprets it row by row. Columns beside a lambda get small methods of their own.
    """
    return F.transform(F.array(value), lambda same: same)[0]

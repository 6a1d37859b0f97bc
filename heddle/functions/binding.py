"""Values that an expression uses several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row: inside lambdas and branches Spark would work it out at every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))

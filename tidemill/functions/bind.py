"""Values that an expression names often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f names often: computed once, and written once into the plan."""
    return F.element_at(F.transform(F.array(c), f), 1)

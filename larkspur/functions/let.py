"""A value worked out once and named, for expressions that look at it more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row. Written out, each use would repeat all below it, and nested uses multiply; what Catalyst finds in common it shares only outside of branches and lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

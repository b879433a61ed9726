"""Naming a value inside one expression, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once (a one-element transform binds it)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

"""Joins that check what they assume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import DataError
from ..schemas import require_unique


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; the right side must have every key of the left, once."""
    require_unique(right, keys, "the right side")
    if not left.join(right, list(keys), "left_anti").isEmpty():
        raise DataError("the right side lacks keys of the left")
    return left.join(right, list(keys))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    require_unique(left, keys, "the left side")
    return many_to_one(left, right, keys)

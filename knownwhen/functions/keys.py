"""Joins on key columns in which NULL is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with NULL meeting NULL; the keys appear once.

    Spark plans null-safe equality as an ordinary equi-join. Use as ``left.transform(match, right, keys, how)``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = {k: f"_kw_on_{k}" for k in keys}
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])
    out = left.join(right.withColumnsRenamed(names), condition, how)
    if how.replace("_", "") in ("semi", "leftsemi", "anti", "leftanti"):
        return out
    if how.replace("_", "") in ("right", "rightouter", "full", "outer", "fullouter"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(names[k])) for k in keys})
    return out.drop(*names.values())

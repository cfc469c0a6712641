"""Joins that no single key can slow down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if one row in so many has it; so there are at most as many hot keys.
HOT_SHARE = 1000


def spread_join(big: DataFrame, unique: DataFrame, key: str | Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """big joined with unique on key, of which unique has one row each; weight: a column of unique, the rows of big with that key.

    Rows of hot keys, HOT_SHARE at most by what hot means, meet a broadcast table where they lie; the others are shuffled, and
    no key among those holds more than a share of 1 / HOT_SHARE of the rows. So no task depends on the largest key.
    Tables read twice should be written ones. The weight is dropped.
    """
    spark, keys = big.sparkSession, [key] if isinstance(key, str) else list(key)
    total = unique.agg(F.sum(weight)).first()[0] or 0
    bound = max(total // HOT_SHARE, 10_000)
    hot = unique.where(F.col(weight) > bound).collect() if total > bound else []  # fewer than HOT_SHARE rows
    plain = unique.drop(weight)
    if not hot:
        return big.join(plain, keys, how)
    few = spark.createDataFrame(hot, unique.schema).drop(weight)
    rest = big.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(unique.where(F.col(weight) <= bound).drop(weight), keys, how)
    return big.join(F.broadcast(few), keys).unionByName(rest)

"""Joins whose keys may be hot on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join (nulls equal nothing): rows of one key on the large side are dealt over
    salts tasks by the columns by, and the small side is there once for each."""
    left = large.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "__salt"], how).drop("__salt")

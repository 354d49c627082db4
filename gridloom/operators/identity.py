"""Ids of filled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import num, text
from .grid import kinds

#: Grid rows of a range of the running number.
BLOCK = 65536


def sequence(df: DataFrame, is_gap: str, start: int, row_id: str = "__grid_id", name: str = "__seq") -> DataFrame:
    """Numbers gap rows from start in row order: counts by range of rows give each range
    its offset, so no task sorts the whole table."""
    block = F.floor(F.col(row_id) / BLOCK)
    counts = df.filter(is_gap).groupBy(block.alias("__block")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__block", is_gap).orderBy(row_id))
    return df.withColumn("__block", block).join(offsets, "__block", "left").withColumn(name, F.when(F.col(is_gap), F.lit(start) + F.col("__before") + rank - 1)).drop("__block", "__before")


def apply(df: DataFrame, column: str, policy: dict, is_gap: str = "__gap", donor=None) -> DataFrame:
    """Modes blank, donor, unique (or sequence) and constant, for gap rows only."""
    mode, own = policy.get("mode", "blank"), F.col(f"`{column}`")
    if mode in ("unique", "sequence"):
        start = policy.get("start")
        if start in (None, ""):
            top = df.filter(~F.col(is_gap)).agg(F.max(num(own, kinds(df)[column]))).first()[0]
            start = int(top) + 1 if top is not None else 1
        df = sequence(df, is_gap, int(start))
        prefix = policy.get("prefix") or ""
        value, kind = (F.concat(F.lit(prefix), F.col("__seq").cast("string")), "string") if prefix else (F.col("__seq"), df.schema[column].dataType)
    elif mode == "constant":
        value, kind = F.lit(policy.get("value")), df.schema[column].dataType
    elif mode == "donor" and donor is not None:
        value, kind = donor, df.schema[column].dataType
    else:
        value, kind = F.lit(None), df.schema[column].dataType
    shown = F.when(own.isNotNull(), text(own, kinds(df)[column])) if kind == "string" else own
    return df.withColumn(column, F.when(F.col(is_gap), value.cast(kind)).otherwise(shown.cast(kind))).drop("__seq")

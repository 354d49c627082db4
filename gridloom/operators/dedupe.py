"""Collapse rows of equal keys; every column by its own strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, materialise
from . import selection
from .skew import salted_join

STRATEGIES = ("first", "last", "sum", "mean", "median", "max", "min", "none")
NUMERIC_ONLY = ("sum", "mean", "median")
#: Rows of a group whose median may come from one buffer.
HOT = 1_000_000


def aggregate(name: str, how: str, dtype: T.DataType, row_id: str) -> Column:
    """first and last skip nulls, by row order; a sum of nulls is 0."""
    c = F.col(f"`{name}`")
    if how in NUMERIC_ONLY and not isinstance(dtype, T.NumericType) or how not in STRATEGIES:
        how = "first"
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        out = pick(c, F.when(c.isNotNull(), F.col(row_id)))
    elif how == "sum":
        out = F.coalesce(F.sum(c), F.lit(0))
    else:
        out = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[how](c)
    return out.alias(name)


def _hot_medians(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame | None:
    """Medians of the columns names, as an array, for groups of more than HOT rows, with
    the group's keys as text in __g; None if there are no such groups."""
    group = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]))
    sized = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT)
    hot = materialise(sized.select(group.alias("__g")), "dedupe-hot")
    if hot.isEmpty():
        discard(hot)
        return None
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(names)])).alias("c")
    rows = df.select(group.alias("__g"), cells).select("__g", "c.*").filter("x is not null")
    found = selection.medians(salted_join(rows, hot, ["__g"], ["x"]), ["__g", "i"])
    by_group = found.groupBy("__g").agg(*[F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"__m{i}") for i in range(len(names))])
    return hot.join(by_group, "__g", "left").withColumn("__hot", F.lit(True))


def dedupe(df: DataFrame, keys: list[str], strategy: str = "first", overrides: dict[str, str] | None = None, row_id: str = "__row_id") -> DataFrame:
    """One row for each exact key (nulls are a key); the group keeps its first row's
    place. Strategy none leaves the table as it is. Medians of groups of more than HOT
    rows come from selection.medians(), others from a buffer of the group's values."""
    keys = [k for k in keys if k in df.columns]
    if not keys or strategy == "none":
        return df
    overrides = overrides or {}
    rest = [f for f in df.schema if f.name not in keys and f.name != row_id]
    how = {f.name: overrides.get(f.name, strategy) for f in rest}
    middle = [f.name for f in rest if how[f.name] == "median" and isinstance(f.dataType, T.NumericType)]
    hot = _hot_medians(df, keys, middle) if middle else None
    group = [F.col(f"`{k}`") for k in keys]
    plain = [aggregate(f.name, how[f.name], f.dataType, row_id) for f in rest if f.name not in middle or hot is None]
    if hot is None:
        out = df.groupBy(*group).agg(F.min(row_id).alias(row_id), *plain)
        return out.select(*[F.col(f"`{c}`") for c in df.columns])
    # A hot group has no buffer: its rows bring nulls to it.
    name = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]))
    marked = salted_join(df.withColumn("__g", name), hot.select("__g", "__hot"), ["__g"], [row_id], "left")
    small = [F.median(F.when(F.col("__hot").isNull(), F.col(f"`{c}`"))).alias(f"__s{i}") for i, c in enumerate(middle)]
    out = marked.groupBy("__g", *group).agg(F.min(row_id).alias(row_id), *plain, *small).join(hot.drop("__hot"), "__g", "left")
    chosen = {c: F.coalesce(f"__s{i}", f"__m{i}").alias(c) for i, c in enumerate(middle)}
    return out.select(*[chosen.get(c, F.col(f"`{c}`")) for c in df.columns])


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))

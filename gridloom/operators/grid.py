"""The grid of required rows: distinct master combinations times reporting dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import key, kind_of, norm_date, num


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema}


def master_filter(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Keep master rows by a normalised comparison; an unknown column or operator keeps all."""
    if column not in df.columns:
        return df
    kind = kinds(df)[column]
    c = key(F.col(f"`{column}`"), kind)
    label = lambda v: str(v).strip().upper()
    number = num(F.col(f"`{column}`"), kind)
    if op in ("gt", "ge", "lt", "le"):
        limit = F.lit(float(value))
        return df.filter({"gt": number > limit, "ge": number >= limit, "lt": number < limit, "le": number <= limit}[op])
    if op in ("eq", "="):
        return df.filter(c == label(value))
    if op in ("ne", "!="):
        return df.filter(c != label(value))
    if op == "in":
        return df.filter(c.isin([label(v) for v in (value if isinstance(value, (list, tuple)) else str(value).split(","))]))
    return df


def dates(spark: SparkSession, new: DataFrame, mode: str = "from_new", explicit: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The reporting dates (__date), ascending, with their ordinal."""
    if mode == "explicit":
        if not explicit:
            raise ValueError("date mode explicit needs a list of dates")
        axis = spark.createDataFrame([(d,) for d in explicit], "d string").select(F.col("d").cast("date").alias("__date")).distinct()
    elif mode == "range":
        if not (start and end):
            raise ValueError("date mode range needs both ends")
        axis = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("__date"))
    else:
        axis = new.select("__date").filter("__date is not null").distinct()
    # At most one row a day of the calendar: the dates come to the driver and are local
    # rows of the plan, so no part of it derives them from the transactions again.
    found = sorted(r[0] for r in axis.collect())
    return spark.createDataFrame(list(zip(found, range(len(found)))), "__date date, __date_ix bigint")


def ordinals(df: DataFrame, by: str, name: str, block: int = 65536) -> DataFrame:
    """Numbers rows 0, 1, ... in the order of an integer column: counts by range of its
    values give each range its offset, so only counts meet in one task."""
    at = F.floor(F.col(by) / block)
    counts = df.groupBy(at.alias("__block")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(by))
    return df.withColumn("__block", at).join(offsets, "__block").withColumn(name, F.col("__before") + rank - 1).drop("__block", "__before")


def _keyed(master: DataFrame, dims: list[str]) -> DataFrame:
    by = kinds(master)
    return master.filter(reduce(Column.__or__, [F.col(f"`{d}`").isNotNull() for d in dims])).withColumns({f"__k{i}": key(F.col(f"`{d}`"), by[d]) for i, d in enumerate(dims)})


def combination_keys(master: DataFrame, dims: list[str]) -> DataFrame:
    """The distinct keys __k0.. alone."""
    return _keyed(master, dims).select(*[f"__k{i}" for i in range(len(dims))]).distinct()


def combinations(master: DataFrame, dims: list[str], carry: list[str]) -> DataFrame:
    """A row for each combination of normalised labels: key columns __k0.., the ordinal,
    and the struct master of the first such row, so no join is needed later."""
    keyed = _keyed(master, dims)
    keys = [f"__k{i}" for i in range(len(dims))]
    first = keyed.groupBy(*keys).agg(F.min("__row_id").alias("__row_id"), F.min_by(F.struct(*[F.col(f"`{c}`") for c in carry]), "__row_id").alias("master"))
    return ordinals(first, "__row_id", "__combo_ix").drop("__row_id")


def grid(combos: DataFrame, axis: DataFrame) -> DataFrame:
    """Combination-major; Spark broadcasts a side below its own size threshold."""
    n = axis.count()
    rows = combos.crossJoin(axis)
    return rows.withColumn("__grid_id", F.col("__combo_ix").cast("bigint") * n + F.col("__date_ix")).drop("__combo_ix", "__date_ix")


def stats(new: DataFrame, combos: DataFrame, axis: DataFrame) -> DataFrame:
    """One row: combinations, dates, expected_rows, new_rows."""
    n, d = combos.agg(F.count("*").alias("combinations")), axis.agg(F.count("*").alias("dates"))
    expected = F.col("combinations") * F.greatest(F.col("dates"), F.lit(1))
    return n.crossJoin(d).crossJoin(new.agg(F.count("*").alias("new_rows"))).select("combinations", "dates", expected.alias("expected_rows"), "new_rows")


def with_date(df: DataFrame, column: str | None) -> DataFrame:
    if not column or column not in df.columns:
        return df.withColumn("__date", F.lit(None).cast("date"))
    return df.withColumn("__date", norm_date(F.col(f"`{column}`"), kinds(df)[column]))


def match_keys(df: DataFrame, columns: list[str], prefix: str = "__k") -> DataFrame:
    by = kinds(df)
    return df.withColumns({f"{prefix}{i}": key(F.col(f"`{c}`"), by[c]) if c in by else F.lit("") for i, c in enumerate(columns)})


def attach_new(cells: DataFrame, new: DataFrame, n_dims: int, carry: list[str], how: str = "left") -> DataFrame:
    """Each cell with the struct new of its first transaction, or null. Duplicates are
    reduced before the join, so a cell never multiplies."""
    keys = [f"__k{i}" for i in range(n_dims)] + ["__date"]
    one = new.filter("__date is not null").groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in carry]), "__row_id").alias("new"))
    return cells.join(one, keys, how)


def variants(new: DataFrame, n_dims: int) -> DataFrame:
    """Transactions beyond the first of their cell, which no output row shows: keys that
    differ as they are written and meet once they are normalised."""
    keys = [f"__k{i}" for i in range(n_dims)] + ["__date"]
    return new.filter("__date is not null").groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dropped_variants"))


def placed(new: DataFrame, combos: DataFrame, axis: DataFrame, n_dims: int) -> DataFrame:
    """new with __in_grid: whether a cell of the whole grid takes the transaction. A cell
    is a combination and a date, so two narrow joins tell it without the grid."""
    keys = [f"__k{i}" for i in range(n_dims)]
    known = combos.select(*keys, F.lit(True).alias("__combo"))
    dated = axis.select("__date", F.lit(True).alias("__on"))
    return new.join(known, keys, "left").join(dated, "__date", "left").withColumn("__in_grid", F.col("__combo").isNotNull() & F.col("__on").isNotNull()).drop("__combo", "__on")

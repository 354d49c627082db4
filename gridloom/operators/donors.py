"""Donor rows for gaps, by a chain of key sets from the strictest to the loosest.

The first level that has a donor wins with its whole row. A donor by keys alone (last,
first, random) does not depend on the date, so it is joined to the combinations, before
these meet the dates. previous and nearest depend on keys and date: the pool is reduced
to one row a key and date, and a window a key runs over its distinct dates and those of
the gaps; its length is bounded by the calendar, whatever the number of rows. Only gaps are
looked for, and each level takes those that the levels before left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialise
from .grid import kinds, match_keys

STRATEGIES = ("last", "first", "random", "previous", "nearest")
DATED = ("previous", "nearest")


def default_chain(dims: list[dict], side: str = "hist") -> list[list[dict]]:
    """All dimensions, then without the leading ones, one less each time."""
    pairs = [{"grid": d["master"], side: d.get(side) or d["master"]} for d in dims]
    return [pairs[i:] for i in range(len(pairs))]


def label(level: list[dict]) -> str:
    return " + ".join(pair["grid"] for pair in level)


class Search:
    """The search in one pool. cells need __k<i> for the i-th of dims; dated() needs
    __date too. settle() turns the columns of the levels into the struct name and
    <name>_level. A level whose columns are missing is skipped."""

    def __init__(self, pool: DataFrame, chain: list[list[dict]], side: str, carry: list[str], strategy: str, dims: list[str], name: str, strict_previous: bool = False, seed: int = 42):
        known = kinds(pool)
        self.levels = [v for v in chain if v and all(p["grid"] in dims and p[side] in known for p in v)]
        self.side, self.carry, self.strategy, self.dims, self.name, self.seed = side, carry, strategy, dims, name, seed
        self.schema = pool.schema
        #: Of each level in turn what it was asked for, and what it found.
        self.opened: list[DataFrame] = []
        #: The tables behind them, for discard().
        self.written: list[DataFrame] = []
        self.columns = list(dict.fromkeys(p[side] for v in self.levels for p in v))
        self.static_levels = [] if strategy in DATED and strict_previous else self.levels
        self.pool = match_keys(pool, self.columns, "__m").withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in carry])) if self.levels else pool

    def _keys(self, level: list[dict]) -> list[tuple[str, str]]:
        """Pairs of a cell's and a pool row's key column."""
        return [(f"__k{self.dims.index(p['grid'])}", f"__m{self.columns.index(p[self.side])}") for p in level]

    def _best(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """One row a key by the strategy; undated rows are before all dates."""
        least = self.strategy in ("first", "random")
        pick = F.min_by if least else F.max_by
        return rows.groupBy(*keys).agg(pick("__row", "__rank").alias("__row"), (F.min if least else F.max)("__rank").alias("__rank"))

    def static(self, cells: DataFrame) -> DataFrame:
        if not self.static_levels:
            return cells
        rank = F.struct(F.xxhash64("__row_id", F.lit(self.seed)).alias("a"), F.col("__row_id").alias("b")) if self.strategy == "random" else F.struct(F.col("__date").alias("a"), F.col("__row_id").alias("b"))
        reduced = self._best(self.pool.withColumn("__rank", rank), [f"__m{i}" for i in range(len(self.columns))])
        for depth, level in enumerate(self.levels):
            keys = self._keys(level)
            found = self._best(reduced, list(dict.fromkeys(m for _, m in keys))).select(*[F.col(m).alias(k) for k, m in keys], F.col("__row").alias(f"__{self.name}{depth}s"))
            cells = cells.join(found, [k for k, _ in keys], "left")
        return cells

    def _write(self, df: DataFrame) -> DataFrame:
        df = materialise(df, "donor-open")
        self.written.append(df)
        return df

    def dated(self, cells: DataFrame, wanted: DataFrame) -> DataFrame:
        """wanted: the keys and dates that ask for a donor. Each level writes its answers once
        and takes those that the levels before left open; what they found comes to the cells
        in one join. A null key or date has no donor by date."""
        if self.strategy not in DATED or not self.levels:
            return cells
        every = [f"__m{i}" for i in range(len(self.columns))]
        reduced = self.pool.filter("__date is not null").groupBy(*every, "__date").agg(F.max_by("__row", "__row_id").alias("__row"), F.max("__row_id").alias("__row_id"))
        if len(self.levels) > 1:
            reduced = self._write(reduced)
        asked = list(dict.fromkeys(k for v in self.levels for k, _ in self._keys(v)))
        rest, found = wanted.filter("__date is not null").select(*asked, "__date").distinct(), None
        for depth, level in enumerate(self.levels):
            keys = self._keys(level)
            names = list(dict.fromkeys(k for k, _ in keys))
            dated = reduced.filter(" and ".join(f"{m} is not null" for _, m in keys))
            donors = dated.groupBy(*[F.col(m).alias(k) for k, m in keys], "__date").agg(F.max_by("__row", "__row_id").alias("row"))
            if set(names) == set(asked):
                answers = asof(donors, rest, names, self.strategy)  # one row for each that asks
            else:
                near = asof(donors, rest.select(*names, "__date").distinct(), names, self.strategy).filter("d is not null")
                answers = rest.join(near, [*names, "__date"], "left")
            answers = self._write(answers.select(*asked, "__date", "d"))
            part = answers.filter("d is not null").withColumn("__depth", F.lit(depth))
            self.opened += [answers.drop("d"), part]
            found = part if found is None else found.unionByName(part)
            if depth + 1 < len(self.levels):
                rest = answers.filter("d is null").drop("d")
                if self.static_levels:
                    # A key of the pool has a donor at this level, if not by date.
                    rest = rest.join(self.pool.select(*[F.col(m).alias(k) for k, m in keys]).distinct(), names, "left_anti")
        slot = lambda i: F.when(F.col("__depth") == i, F.col("d")).alias(f"__{self.name}{i}a")
        placed = found.select(*asked, "__date", *[slot(i) for i in range(len(self.levels))])
        return cells.join(placed, [*asked, "__date"], "left")

    def settle(self, cells: DataFrame, wanted: Column | None = None) -> DataFrame:
        """wanted: the rows that take a donor; others get none."""
        donors: list[Column] = []
        for depth in range(len(self.levels)):
            slots = [f"__{self.name}{depth}{s}" for s in "as" if f"__{self.name}{depth}{s}" in cells.columns]
            if slots:
                donors.append(F.coalesce(*[F.col(s) for s in slots]))
        wanted = F.lit(True) if wanted is None else wanted
        if donors:
            row = F.when(wanted, F.coalesce(*donors))
            level = F.when(wanted, F.coalesce(*[F.when(d.isNotNull(), F.lit(label(v))) for d, v in zip(donors, self.levels)]))
        else:
            empty = "struct<" + ",".join(f"`{c}`:{self.schema[c].dataType.simpleString()}" for c in self.carry) + ">"
            row, level = F.lit(None).cast(empty), F.lit(None).cast("string")
        out = cells.withColumns({self.name: row, f"{self.name}_level": level})
        return out.drop(*[f"__{self.name}{i}{s}" for i in range(len(self.levels)) for s in "as"])


def asof(donors: DataFrame, wanted: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """(keys, __date, d): the donor at or before each wanted date, or the nearest one (of
    two equally near, the earlier). donors: one row a key and date; wanted: distinct."""
    row = F.struct(F.col("__date").alias("at"), F.col("row"))
    both = donors.select(*keys, "__date", F.lit(0).alias("side"), row.alias("d")).unionByName(wanted.select(*keys, "__date", F.lit(1).alias("side"), F.lit(None).alias("d")))
    seen = lambda order: F.last("d", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("b", seen(F.asc("__date")))
    if strategy == "previous":
        return both.filter("side = 1").select(*keys, "__date", F.col("b.row").alias("d"))
    found = both.withColumn("f", seen(F.desc("__date"))).filter("side = 1")
    before = F.col("f").isNull() | (F.datediff("__date", F.col("b.at")) <= F.datediff(F.col("f.at"), F.col("__date")))
    return found.select(*keys, "__date", F.when(F.col("b").isNotNull() & before, F.col("b.row")).otherwise(F.col("f.row")).alias("d"))


def pick(gaps: DataFrame, pool: DataFrame, chain: list[list[dict]], side: str, carry: list[str], strategy: str = "last", dims: list[str] | None = None, as_name: str = "donor", strict_previous: bool = False) -> DataFrame:
    """Adds the struct as_name and <as_name>_level to gaps (which have __k* keys of dims
    in order, and __date)."""
    search = Search(pool, chain, side, carry, strategy, dims or [], as_name, strict_previous)
    return search.settle(search.dated(search.static(gaps), gaps))

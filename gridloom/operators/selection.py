"""Exact medians of groups of any size.

A group's middle ranks are found by histograms that are refined: its values are counted in
BINS bins between their least and largest (map-side, so a hot group sends each task a row a
bin), the bin that holds the rank becomes the next range, and so on until the range is one
value or holds few enough to be sorted. No task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialise
from .skew import salted_join

BINS = 4096
#: Values that one task may sort for a group.
FEW = 10_000
LARGEST = 1.7976931348623157e308


def medians(cells: DataFrame, groups: list[str]) -> DataFrame:
    """cells: the columns groups, none null, and x double (not null). Rows of groups with
    their median. Infinities count as the largest finite numbers."""
    x = F.greatest(F.least("x", F.lit(LARGEST)), F.lit(-LARGEST))
    cells = materialise(cells.select(*groups, x.alias("x")), "median-cells")
    whole = cells.groupBy(*groups).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rank = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor((F.col("n") - 1) / 2).alias("k")), F.struct(F.lit(1).alias("side"), F.floor(F.col("n") / 2).alias("k"))))
    open_ranks = materialise(whole.select(*groups, "n", "lo", "hi", rank.alias("r")).select(*groups, "n", "lo", "hi", "r.*"), "median-ranks")
    by, done = [*groups, "side"], []
    while True:
        settled = open_ranks.filter("lo = hi").select(*by, F.col("lo").alias("v"))
        few = open_ranks.filter((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW))
        within = salted_join(cells, few, groups, ["x"]).filter("x between lo and hi")
        sorted_out = within.groupBy(*by, "k").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(*by, F.get("xs", F.col("k").cast("int")).alias("v"))
        done.append(materialise(settled.unionByName(sorted_out), "median-found"))
        more = open_ranks.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if more.isEmpty():
            break
        # Halves keep the width finite; the bin never falls as x rises.
        place = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_of = F.least(F.floor(place * BINS), F.lit(BINS - 1))
        counted = salted_join(cells, more, groups, ["x"]).filter("x between lo and hi").groupBy(*by, "k", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counted.withColumn("before", before).filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
        after = materialise(held.select(*groups, "n", "lo", "hi", "side", (F.col("k") - F.col("before")).alias("k")), "median-ranks")
        discard(open_ranks)
        open_ranks = after
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    found = materialise(out.groupBy(*groups).agg((F.min("v") / 2 + F.max("v") / 2).alias("median")), "median-out")
    discard(cells, open_ranks, *done)
    return found

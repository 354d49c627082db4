"""Mixing sources to target weights by entropy balancing.

A document of s words gets a rate r in (0, 2): the mean number of its copies.
Among all rates whose words meet every source's target, those nearest to one
copy each (in the entropy of r and 2 - r) are r = 2 / (1 + exp(-lambda * s)):
an exponential tilt in the constraint's own coefficient, held under the limit of
2. One lambda a source solves the convex dual; Newton steps sum gradient and
curvature by source over the table, held in a bracket that a bisection halves where
a step would leave it, until every source meets its target. Rows of equal source and
size have equal rates, so the steps read their counts, which is exact.

Rounding: by falling size, the documents of a source and size get so many extra
copies in all that the words taken follow the sum of the rates; the remainder
is carried to the next size. Which of the equal-sized documents get them follows
the hash of doc_id, ranked within salts, so reruns agree.

Edge cases: a null source is the last source; null or empty texts have size 0
and take nothing; a null doc_id ranks by its text's hash; a source without words
has target 0; repeated rows are documents of their own and tied rows share copies
by any order of the two; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, boxed, column, discard, materialise, salted_join, table, text_or_empty, unboxed

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, LIMIT = 1.5, 2.0
NEWTON_STEPS, SALTS = 80, 32
#: Share of its target by which a source's words may still differ after a step.
TOLERANCE = 1e-7
#: Steepest tilt: at it, a source's rates are its limit in double precision.
STEEPEST = 700.0


def word_count(text) -> "F.Column":
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds _n, the source's place by code point, null last: 1, 2, ... Ranges of names
    are numbered apart and get their offsets from the ranges' counts."""
    order = [F.desc("_known"), F.asc("_source")]
    parts = materialise(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = materialise(parts.join(offsets, "_part").withColumn("_n", F.col("_before") + place).drop("_part", "_before"), "mix-ranked")
    discard(parts)
    return out


def source_targets(sources: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, limit: float = LIMIT) -> DataFrame:
    """sources: _source, _known (false for null), source_size. Adds target: the
    weights' shares of total_share of all words, at most limit times a source's
    words; what is above is shared again by weight. Each round sums over all sources
    what those at their limit take and what weight the others have, which gives the
    next level (words a unit of weight); the level only rises, and rounds end when no
    further source reaches its limit."""
    weighted = ranked(sources).withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_n") - 1, F.lit(len(weights))).cast("int")))
    top, level, full = limit * F.col("source_size"), -1.0, None
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        at_limit = F.col("_weight") * F.lit(level) > top
        held, spent, free = weighted.agg(F.count_if(at_limit), F.coalesce(F.sum(F.when(at_limit, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_limit, F.col("_weight"))), F.lit(0.0))).first()
        if held == full or not free:
            break
        full, level = held, (total_share * total - spent) / free
    return weighted.withColumn("target", F.least(top, F.col("_weight") * F.lit(level))).select("_source", "_known", "source_size", "target")


def _rate() -> "F.Column":
    return LIMIT / (1 + F.exp(-F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), F.col("_lambda") * F.col("_x")))))


def solve(classes: DataFrame, targets: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """classes: _source, _known, size, n. The dual's solution by source: _lambda, with
    sizes scaled by the source's mean (_mean). A source whose target is its limit is at
    the steepest tilt. A step is cut to a factor of four in the odds of the mean
    document; one that leaves the bracket (the words taken rise with lambda) goes to its
    middle instead. It is an error if a source does not meet its target after all steps."""
    keys = ["_source", "_known"]
    means = classes.groupBy(*keys).agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("_mean"))
    full = F.col("target") >= LIMIT * F.col("source_size") * (1 - 1e-12)
    start = targets.join(means, keys).withColumns({"_lambda": F.when(full, F.lit(STEEPEST)).otherwise(F.lit(0.0)), "_low": F.lit(-STEEPEST), "_high": F.lit(STEEPEST), "_gap": F.lit(1.0)})
    state, gap = materialise(start, "mix-dual"), 0.0
    for _ in range(steps):
        rows = salted_join(classes, state, keys, ["size"]).withColumn("_x", F.col("size") / F.greatest(F.col("_mean"), F.lit(1e-9))).withColumn("_r", _rate())
        sums = rows.groupBy(*keys).agg(
            F.sum(F.col("n") * F.col("size") * F.col("_r")).alias("_g"),
            F.sum(F.col("n") * F.col("size") * F.col("_x") * F.col("_r") * (1 - F.col("_r") / LIMIT)).alias("_h"),
        )
        done = F.col("_lambda") >= STEEPEST
        low = F.when(F.col("_g") < F.col("target"), F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(F.col("_g") > F.col("target"), F.col("_lambda")).otherwise(F.col("_high"))
        move = F.coalesce(F.try_divide(F.col("target") - F.col("_g"), F.col("_h")), F.lit(0.0))
        there = F.col("_lambda") + F.greatest(F.lit(-1.5), F.least(F.lit(1.5), move))
        there = F.when((there < low) | (there > high), (low + high) / 2).otherwise(there)
        off = F.when(done, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.abs(F.col("target") - F.col("_g")), F.col("target")), F.lit(0.0)))
        after = state.drop("_gap").join(sums, keys, "left").select(*keys, "source_size", "target", "_mean", F.when(done, F.col("_lambda")).otherwise(there).alias("_lambda"), low.alias("_low"), high.alias("_high"), off.alias("_gap"))
        after = materialise(after, "mix-dual")
        discard(state)
        state = after
        # One number for all sources; the last step has squared this gap once more.
        gap = state.agg(F.max("_gap")).first()[0] or 0.0
        if gap < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the mix misses a target by {gap:.2g} of it after {steps} steps")
    # Sums of doubles differ in their last digits between runs; the rates shall not.
    return state.withColumn("_lambda", F.round("_lambda", 9)).drop("_low", "_high")


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's sizes (at most the square root of twice its words): copies of all
    documents of a size together, by falling size, with the remainder carried."""
    pdf = pdf.sort_values("size", ascending=False)
    size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    want, copies, carried = pdf["_r"].to_numpy() * n, np.zeros(len(pdf), np.int64), 0.0
    for i in range(len(pdf)):
        exact = want[i] + carried / size[i]
        copies[i] = min(max(round(exact), 0), int(LIMIT) * n[i])
        carried = (exact - copies[i]) * size[i]
    return pdf.assign(copies=copies)[["_source", "_known", "size", "n", "copies"]]


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE) -> DataFrame:
    """For every document its row as the struct row, doc_id, size, source_size, target
    and copies (0, 1 or 2)."""
    sized = boxed(
        docs,
        doc_id=column(docs, "doc_id", "bigint"),
        size=word_count(text_or_empty(docs)),
        _source=F.coalesce(column(docs, "source", "string"), F.lit("")),
        _known=column(docs, "source", "string").isNotNull(),
        _h=F.xxhash64(F.coalesce(column(docs, "doc_id", "bigint").cast("string"), column(docs, "text", "string"))),
    ).withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int"))
    keys = ["_source", "_known"]
    slots = materialise(sized.groupBy(*keys, "size", "_salt").agg(F.count("*").alias("n")), "mix-slots")
    classes = materialise(slots.groupBy(*keys, "size").agg(F.sum("n").alias("n")), "mix-sizes")
    targets = materialise(source_targets(classes.groupBy(*keys).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total_share), "mix-targets")
    dual = solve(classes, targets)
    rated = salted_join(classes.filter("size > 0"), dual, keys, ["size"]).withColumn("_x", F.col("size") / F.col("_mean")).withColumn("_r", _rate()).select(*keys, "size", "n", "_r")
    counts = rated.groupBy(*keys).applyInPandas(_round, "_source string, _known boolean, size bigint, n bigint, copies bigint")
    # Copies of a size go to its salts in order: floor(copies / n) for each row, one more for the first ones.
    upto = Window.partitionBy(*keys, "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = slots.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n").join(counts, [*keys, "size"])
    shares = materialise(shares.select(*keys, "size", "_salt", F.floor(F.col("copies") / F.col("n")).alias("_each"), (F.pmod("copies", "n") - F.col("_before")).alias("_more")), "mix-shares")
    rank = F.row_number().over(Window.partitionBy(*keys, "size", "_salt").orderBy("_h"))
    ranked = sized.withColumn("_rank", rank)
    got = ranked.join(shares, [*keys, "size", "_salt"], "left").join(targets, keys, "left")
    copies = F.coalesce(F.col("_each") + (F.col("_rank") <= F.col("_more")).cast("int"), F.lit(0)).cast("bigint")
    return got.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix(docs).filter("copies > 0")
    return unboxed(mixed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

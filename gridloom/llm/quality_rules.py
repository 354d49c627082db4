"""Quality rules: base counts of a text and robust multivariate outliers.

Everything is DataFrame functions. A document's four counts become a vector of
variance-stabilised statistics (log word length; arcsine square roots of the
symbol, repeated-line and repeated-word shares). For each language and source a
regularised minimum-covariance-determinant estimate is fitted by concentration
steps over the whole table: group sums give mean and covariance, a histogram of
distances a group gives the h-subset (all rows up to the bin in which the h-th lies).
Steps go on until no group's determinant falls, and of two starts the smaller stays. A
document whose squared Mahalanobis distance exceeds the chi-square cut-off is rejected.

FLOORS and TAIL are wide as real texts have heavier tails than normal ones: over 10,000
labelled documents they reject all of low quality that pass the base rules and none of
high quality; floors of 0.1 for the repeats reject 10 good ones more and no bad one,
0.05 with a tail of 1e-6 reject 116 good ones.

Statistics are fixed-point integers, so group sums are exact and reruns agree.

Edge cases: null or empty text has no words, so base_failed is true and kept is
false; null language or source is a group of its own; groups under `min_group`
passing rows use their language's estimate, then that of the whole table; a
table without passing rows has no estimate and keeps nothing; repeated rows are
counted and judged one by one; extra columns are ignored by the query and kept
by the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, column, discard, materialise, salted_join, table, text_or_empty, unboxed, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group's rows in the h-subset.
H_SHARE = 0.75
#: Chance of a regular document to be rejected, under normality.
TAIL = 1e-9
#: Standard deviations that every estimate has at least (regularisation).
FLOORS = (0.05, 0.035, 0.2, 0.2)
MIN_GROUP, C_STEPS, D = 100, 20, 4
#: Concentration ends when no log determinant falls by more than this, or at C_STEPS.
SETTLED = 0.01
#: Fixed point of the statistics.
UNIT = 4096
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for j in range(1, dof // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(p_upper: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        term = total = 1.0
        for j in range(1, dof // 2):
            term *= mid / 2 / j
            total += term
        lo, hi = (mid, hi) if math.exp(-mid / 2) * total > p_upper else (lo, mid)
    return hi


CUTOFF = _chi2_quantile(TAIL, D)
#: Makes the h-subset's covariance consistent for normal data.
CONSISTENCY = H_SHARE / _chi2_cdf(_chi2_quantile(1 - H_SHARE, D), D + 2)


def base_counts(df: DataFrame) -> DataFrame:
    """Adds the columns of BASE, from the column text.

    A window of three words is its 64-bit hash. The windows sorted by hash show
    the repeated ones side by side; the words that these cover are counted."""
    text = text_or_empty(df)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_w")
    windows = F.when(
        n < 4, F.array().cast("array<struct<h:bigint,i:int>>")
    ).otherwise(
        F.transform(
            F.slice("_w", 1, F.greatest(n - 2, F.lit(1))),
            lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
        )
    )

    def starts(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    return (
        df.withColumn("_w", words(text))
        .withColumn("_lines", lines)
        .withColumn("_again", F.transform(F.array(F.sort_array(windows)), starts)[0])
        .withColumns(
            {
                "n_words": n.cast("bigint"),
                "word_chars": F.char_length(F.array_join("_w", "")).cast("bigint"),
                "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
                "n_lines": F.size("_lines").cast("bigint"),
                "n_repeat_words": covered,
            }
        )
        .drop("_w", "_lines", "_again")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def _vector() -> list[Column]:
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.try_divide(F.col(a), F.col(b)))))
    values = [F.log(F.try_divide(F.col("word_chars"), F.col("n_words"))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.when(~F.col("base_failed"), F.round(v * UNIT).cast("bigint")).alias(f"z{j}") for j, v in enumerate(values)]


def _keys(stats: DataFrame, min_group: int) -> DataFrame:
    """The group whose estimate judges a language and source."""
    sizes = stats.filter("z0 is not null").groupBy("_l", "_s").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("_l").agg(F.sum("n").alias("n_l"))
    key = F.when(F.col("n") >= min_group, F.concat_ws("\t", "_l", "_s")).when(F.col("n_l") >= min_group, F.col("_l")).otherwise(F.lit(""))
    return sizes.join(by_lang, "_l").select("_l", "_s", key.alias("_key"))


def _quantile_bin(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin at which a group's cumulative count reaches the share."""
    counts = df.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.select(*keys, "bin", F.sum("n").over(upto).alias("_c"), F.sum("n").over(group).alias("_t"))
        .filter(F.col("_c") >= F.ceil(F.col("_t") * share))
        .groupBy(*keys)
        .agg(F.min("bin").alias("bin"))
    )


def _estimates(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the regularised covariance by _key and start."""
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    sums = rows.groupBy("_key", "start").agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(f"z{i}").cast("double").alias(f"s{i}") for i in range(D)],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).cast("double").alias(f"s{i}{j}") for i, j in pairs],
    )
    out = sums.select(
        "_key", "start", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(D)],
        *[
            (CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))) + F.lit((FLOORS[i] * UNIT) ** 2 if i == j else 0.0)).alias(f"k{i}{j}")
            for i, j in pairs
        ],
    )
    for i, j in pairs:
        rest = F.col(f"k{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00"))
    return out.select("_key", "start", logdet.alias("logdet"), *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in pairs])


def _distance2() -> Column:
    y: list[Column] = []
    for i in range(D):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _bin(d2: Column) -> Column:
    return F.floor(32 * F.log2(1 + d2)).cast("int").alias("bin")


def fit_mcd(stats: DataFrame, c_steps: int = C_STEPS) -> DataFrame:
    """Estimates by _key from rows (_key, z0..): two deterministic starts, the
    nearest to the medians and all rows; after the concentration steps the one
    of smaller determinant stays."""
    z = [f"z{i}" for i in range(D)]
    rows = stats.filter("z0 is not null").select("_key", *z)
    melted = rows.select("_key", F.posexplode(F.array(*[F.col(c) for c in z])).alias("j", "v")).select("_key", "j", F.floor(F.col("v") / 4).cast("int").alias("bin"))
    medians = materialise(
        _quantile_bin(melted, ["_key", "j"], 0.5).groupBy("_key").agg(*[F.max(F.when(F.col("j") == i, 4 * F.col("bin") + 2)).alias(f"c{i}") for i in range(D)]), "mcd-medians"
    )
    near = salted_join(rows, medians, ["_key"], z)
    d0 = sum(((F.col(f"z{i}") - F.col(f"c{i}")) / (FLOORS[i] * UNIT)) ** 2 for i in range(D))
    binned = near.select("_key", *z, _bin(d0))
    cut = materialise(_quantile_bin(binned, ["_key"], H_SHARE).withColumnRenamed("bin", "cut"), "mcd-cut")
    first = salted_join(binned, cut, ["_key"], z).filter("bin <= cut").select("_key", F.lit(0).alias("start"), *z)
    params = materialise(_estimates(first.unionByName(rows.withColumn("start", F.lit(1)))), "mcd-fit")
    discard(medians, cut)
    for _ in range(c_steps):
        binned = salted_join(rows, params, ["_key"], z).select("_key", "start", *z, _bin(_distance2()))
        cut = materialise(_quantile_bin(binned, ["_key", "start"], H_SHARE).withColumnRenamed("bin", "cut"), "mcd-cut")
        subset = salted_join(binned, cut, ["_key", "start"], z).filter("bin <= cut")
        step = materialise(_estimates(subset), "mcd-step")
        was = params.select("_key", "start", F.col("logdet").alias("was"))
        fell = step.join(was, ["_key", "start"]).agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        # Subsets end at a bin, so a step may lead back: the smaller determinant stays.
        row = F.struct(*[F.col(c) for c in step.columns])
        after = params.unionByName(step).groupBy("_key", "start").agg(F.min_by(row, "logdet").alias("r")).select("r.*")
        after = materialise(after, "mcd-fit")
        discard(params, step, cut)
        params = after
        if (fell or 0.0) <= SETTLED:
            break
    best = Window.partitionBy("_key").orderBy("logdet", "start")
    return params.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "start", "logdet")


def judge(docs: DataFrame, min_group: int = MIN_GROUP, rows: bool = False) -> DataFrame:
    """doc_id (or, with rows, the whole row as the struct row), the columns of BASE,
    base_failed, distance2 and kept for each document."""
    carry = "row" if rows else "doc_id"
    named = {"doc_id": column(docs, "doc_id", "bigint"), "text": column(docs, "text", "string"), "_lang": column(docs, "lang", "string"), "_source": column(docs, "source", "string")}
    counted = base_counts(boxed(docs, **named))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    stats = materialise(counted.select(carry, *BASE, "base_failed", tag("_lang").alias("_l"), tag("_source").alias("_s"), *_vector()), "quality")
    keys = materialise(_keys(stats, min_group), "quality-keys")
    z = [f"z{i}" for i in range(D)]
    keyed = salted_join(stats, keys, ["_l", "_s"], ["n_words", "word_chars", *z], "left")
    params = materialise(fit_mcd(keyed.select("_key", *z)), "quality-params")
    judged = salted_join(keyed, params, ["_key"], ["n_words", "word_chars", *z], "left").withColumn("distance2", _distance2())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(False))
    return judged.select(carry, *BASE, "base_failed", "distance2", kept.alias("kept"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns."""
    return unboxed(judge(docs, rows=True).filter("kept"), docs)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))

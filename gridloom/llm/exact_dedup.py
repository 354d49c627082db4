"""Exact dedup by skew-safe combining.

Texts are grouped by digest and full content in three steps: within each map
task (the partial aggregation), then by digest and salt, then the winners of the
salts by digest. The full text is part of the grouping key in every step, so
rows merge on equal content only. Partial aggregation sends each task at most
one row of a text a map task, and the salt divides those of a hot text.

Edge cases: a null text counts as empty; a null doc_id is below all others; of
rows that repeat both doc_id and text one stays; an empty table gives an empty
result. The filter returns whole rows; its winner among rows with the same
doc_id and text is the largest by the other orderable columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, column, materialise, salted_join, table, text_or_empty

SALTS = 16


def _combine(rows: DataFrame, first: list, again: list) -> DataFrame:
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    local = rows.withColumn("_salt", salt).groupBy("_digest", "_text", "_salt").agg(*first)
    return local.groupBy("_digest", "_text").agg(*again)


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def copies(docs: DataFrame, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256. digest
    may be any digest of the text: groups are those of equal content, and members are
    found by digest alone only if no two texts of the table share one."""
    text = text_or_empty(docs)
    keyed = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), text.alias("_text"), digest(text).alias("_digest"))
    groups = _combine(
        keyed,
        [F.max("doc_id").alias("m"), F.count("*").alias("c")],
        [F.max("m").alias("keep_id"), F.sum("c").alias("group_size")],
    )
    by_digest = groups.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = materialise(by_digest.filter("_texts > 1 or group_size > 1"), "copies")
    if by_digest.filter("_texts > 1").isEmpty():
        return _members(keyed, by_digest.drop("_texts"), ["_digest"], F.lower(F.hex("_digest")) if digest is _sha256 else None)
    # Texts of equal digest: the members of every group are found by content.
    return _members(keyed, groups.filter("group_size > 1"), ["_digest", "_text"])


def _members(keyed: DataFrame, groups: DataFrame, on: list[str], named: Column | None = None) -> DataFrame:
    """groups: those of two rows at least. Rows that repeat doc_id and text are
    counted first and told apart again at the end, so that one of them stays. named:
    the SHA-256 if the key columns give it, so that texts do not have to move for it."""
    if named is None:
        keyed, named = keyed.withColumn("_sha", F.sha2("_text", 256)), F.col("_sha")
        extra = [F.max("_sha").alias("_sha")]
    else:
        extra = []
    rows = keyed.groupBy(*on, "doc_id").agg(F.count("*").alias("_rows"), *extra)
    joined = salted_join(rows, groups, on, ["doc_id"], "left", SALTS)
    keep = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("_top"),
        named.alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("_i"),
    ).select("doc_id", "keep_id", "group_size", (F.col("_top") & (F.col("_i") == 1)).alias("kept"), "text_sha256")


def winners(docs: DataFrame) -> DataFrame:
    """One whole row for each distinct text: that of the largest doc_id."""
    text = text_or_empty(docs)
    rows = boxed(docs, ("text",), _id=column(docs, "doc_id", "bigint"), _text=text, _digest=_sha256(text), _null=column(docs, "text", "string").isNull())
    plain = [f"row.v{i}" for i, f in enumerate(docs.schema) if f.name != "text" and f.dataType.typeName() in ("string", "long", "integer", "double", "boolean", "date", "timestamp")]
    order = F.struct(F.col("_id").alias("a"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(plain)], F.col("_null").alias("c"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    whole = F.struct("row", "_null")
    local = rows.withColumn("_salt", salt).groupBy("_digest", "_text", "_salt").agg(F.max_by(whole, order).alias("_row"), F.max(order).alias("_order"))
    best = local.groupBy("_digest", "_text").agg(F.max_by("_row", "_order").alias("_row"))
    back = [F.when(~F.col("_row._null"), F.col("_text")).alias(c) if c == "text" else F.col(f"_row.row.v{i}").alias(c) for i, c in enumerate(docs.columns)]
    return best.select(*back)


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, with all columns."""
    return winners(docs)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}

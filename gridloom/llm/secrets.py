"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base patterns are reported wherever they match. Weak candidates (a client or user
identifier, a bare key, a service endpoint) are common in clean text, so each is
reported only if a complementary part lies within SCOPE code points in the same
text: an identifier or endpoint needs a secret, a bare key needs an identifier or
an endpoint. Base matches count as parts too. A bare key is a whole run of at least 20
of its characters that holds a digit, an upper and a lower case letter, in any order.

Offsets: the pieces between a pattern's matches and the matches themselves come in
the same order, so running sums of their lengths place every match. The co-occurrence
test is an interval join: parts are put into every SCOPE-wide bin they touch and
reduced to the first start and last end by bin and role, and a candidate joins the bins
within reach; so a text with thousands of parts makes no pairs among them.

Edge cases: null and empty texts have no spans, zero counts and the digest of an
empty string; repeated rows are scanned one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, materialise, table, text_or_empty

# Kinds in the order of the listing, their patterns, and the group
# whose length counts with the least it must have.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "id": (r"""(?i)\b(client_?id|access_?key_?id|account_?id|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    "key": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"""(?i)\b(https?|s3|ftp|sftp|postgres(ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
BASE = ("assign", "access", "hex")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
#: Roles of which one must be in reach.
NEEDS = {"id": ("secret",), "key": ("identifier", "endpoint"), "endpoint": ("secret",)}
SCOPE = 400


def _matches(text: Column, kind: str) -> Column:
    """Structs of a text's matches: kind, order, the piece's length before and the
    match's own, and whether it is long enough."""
    pattern, group, least = KINDS[kind]
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def one(m: Column, i: Column) -> Column:
        part = F.regexp_extract(m, pattern, group) if group else m
        good = F.char_length(part) >= least
        if kind == "key":
            good = good & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.lit(0).alias("gap"), F.char_length(m).alias("n"), good.alias("good"))

    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,good:boolean>>")
    both = F.zip_with(F.transform(found, one), pieces, lambda m, p: F.when(m.isNotNull(), F.struct(m["kind"].alias("kind"), m["i"].alias("i"), F.char_length(p).alias("gap"), m["n"].alias("n"), m["good"].alias("good"))))
    return F.when(text.rlike(pattern), F.filter(both, lambda x: x.isNotNull())).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (doc, doc_id, kind, start, end): every good match; a row of null kind for
    a text without one. doc tells apart rows of equal doc_id."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), column(docs, "doc_id", "bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    found = F.concat(*[_matches(F.col("text"), k) for k in KINDS])
    spread = rows.select("doc", "doc_id", F.explode_outer(found).alias("m")).select("doc", "doc_id", "m.*")
    upto = Window.partitionBy("doc", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    placed = spread.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    # A text whose matches are all too short keeps its row.
    return placed.select("doc", "doc_id", F.when(F.col("good"), F.col("kind")).alias("kind"), "start", "end")


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """candidates() without the weak ones that overlap a base match or lack a
    complementary part."""
    # Written once: the patterns run over the texts a single time, and both sides of the
    # join below read the same numbers of the rows.
    rows = materialise(candidates(docs), "secret-candidates")
    base = F.col("kind").isin(*BASE)
    # Both frames grow from their first row: one that shrinks is read anew for each row.
    at = Window.partitionBy("doc").orderBy("start", F.desc("end"), "kind")
    back = Window.partitionBy("doc").orderBy(F.desc("start"), "end", F.desc("kind"))
    before = F.max(F.when(base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    clear = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    rows = rows.withColumn("_clear", base | clear).withColumn("kind", F.when(F.col("_clear"), F.col("kind"))).drop("_clear")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("kind"))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    parts = (
        rows.filter(F.col("kind").isNotNull())
        .select("doc", role.alias("role"), "start", "end", F.explode(F.sequence(first, last)).alias("bin"))
        .groupBy("doc", "bin", "role")
        .agg(F.min("start").alias("p_start"), F.max("end").alias("p_end"))
    )
    weak = rows.filter(~base).select("doc", "kind", "start", "end", first.alias("first"), last.alias("last"), F.explode(F.sequence(first - 1, last + 1)).alias("bin"))
    reach = (F.col("bin").between(F.col("first"), F.col("last"))) | (
        F.when(F.col("bin") < F.col("first"), F.col("start") - F.col("p_end")).otherwise(F.col("p_start") - F.col("end")) <= scope
    )
    fits = F.lit(False)
    for kind, roles in NEEDS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("role").isin(*roles))
    linked = weak.join(parts, ["doc", "bin"]).filter(reach & fits).groupBy("doc", "kind", "start").agg(F.lit(True).alias("_linked"))
    joined = rows.join(linked, ["doc", "kind", "start"], "left")
    return joined.withColumn("kind", F.when(base | F.col("_linked"), F.col("kind"))).drop("_linked")


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each document: counts and listing of its spans."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("text")))
    grouped = spans(docs, scope).groupBy("doc", "doc_id").agg(
        F.count_if(F.col("kind") == "assign").alias("n_assign"),
        F.count_if(F.col("kind") == "access").alias("n_access"),
        F.count_if(F.col("kind") == "hex").alias("n_hex"),
        F.array_sort(F.collect_list(span)).alias("s"),
    )
    listing = lambda keep: F.array_join(F.transform(F.filter("s", keep), lambda x: x["text"]), ",")
    return grouped.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(listing(lambda x: x["order"] <= len(BASE)), 256).alias("base_sha256"),
        listing(lambda x: F.lit(True)).alias("spans"),
    )


def op8_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))

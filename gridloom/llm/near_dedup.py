"""MinHash near-dedup with sequential Bayesian verification.

1. Each document becomes the set of its word 5-shingles (64-bit hashes), a MinHash
   signature and the keys of its bands. Documents of equal word sequences form one
   class and go on as its smallest doc_id.
2. Classes that share a band are candidates. First each bucket compares its members
   with one pivot, so a group of copies gives as many pairs as members. Buckets that
   the links found leave in several components are then compared in full, inside tasks:
   a bucket is dealt over tiles of about TILE by TILE members (fewer where their sets are
   large, TILE_SHINGLES a side), a tile skips what is in one component already or met in
   an earlier band, and sends one link for each two components that it joins. So no
   candidate link between components is lost, and no pairs of a group are written out.
3. A candidate's signatures are compared batch by batch. With a uniform prior on the
   similarity J, m matches of n give J a Beta(m + 1, n - m + 1) posterior; the pair is
   dropped once P(J >= threshold) falls under the chosen miss probability.
4. Survivors are confirmed on the full shingle sets, as words, and linked.
5. Links become components by alternating large-star and small-star steps.

Nothing but counts reaches the driver. Links need `percent` of the union. The banding
misses a pair of similarity 0.85 with probability (1 - 0.85^6)^24 = 1e-5, and one of 0.8
with five rows a band with probability (1 - 0.8^5)^28 = 1.5e-5.

Edge cases: null, empty or blank text has an empty set and is a component alone; a
text of fewer than five words is one shingle; a null doc_id is its own component
(component_id null, kept true); rows that repeat a doc_id with the same words share its
component and are both kept (exact dedup removes them); rows that repeat a doc_id with
other words are documents of their own, linked and kept or dropped each by its words; an
empty table gives no rows; other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, column, discard, likely, materialise, salted_join, table, text_or_empty, unboxed

SHINGLE = 5
#: Links need 100 * intersection >= percent * union; the query's and the stage's percent.
PERCENT, STAGE_PERCENT = 85, 80
HASHES = 144
#: Signature values compared at a time, and the chance to drop a true link there.
BATCH, MISS = 24, 1e-6
#: Members of a bucket, and shingles of theirs, on one side of a tile.
TILE, TILE_SHINGLES = 512, 1 << 21
SALTS, PIVOT_SALTS = 16, 64


def rows_a_band(percent: int) -> int:
    """Six of the HASHES values, or five where lower similarities must meet."""
    return 6 if percent >= 85 else 5

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_ROLL = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of all words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    n = len(words) - SHINGLE + 1
    total = h[:n] * _ROLL[0]
    for j in range(1, SHINGLE):
        total = _mix(total) + h[j : j + n] * _ROLL[j]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        values = shingles[None, at : at + 256] * _MULTIPLY[:, None]
        values += _ADD[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


FEATURES = "doc_id bigint, cls binary, n_shingles bigint, sig binary, bands array<bigint>"


def _features(rows: int):
    bands = HASHES // rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                shingles = shingle_hashes(words)
                if len(shingles):
                    sig = signature(shingles)
                    keys = _mix(_fold(sig[: bands * rows].reshape(bands, rows))).view(np.int64)
                    out.append((doc_id, xxhash.xxh3_128_digest(b" ".join(words)), len(shingles), _mix(sig).astype(np.uint16).tobytes(), keys.tolist()))
                else:
                    out.append((doc_id, None, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "cls", "n_shingles", "sig", "bands"])

    return run


def _hashes(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_hashes(words_of(t)).tobytes() for t in texts])


def _fold(rows: np.ndarray) -> np.ndarray:
    total = np.arange(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return total


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For n = BATCH, 2 BATCH, ...: the fewest matches that stay a candidate."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # P(J >= t) under Beta(m+1, n-m+1) is the chance of at most m hits of n+1 at rate t.
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Sequential comparison of signatures, row by row: indices that stay candidates."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, few in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= few]
    return alive


def plausible(percent: int):
    least = least_matches(percent / 100)

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(left), np.uint16).reshape(-1, HASHES)
        b = np.frombuffer(b"".join(right), np.uint16).reshape(-1, HASHES)
        out = np.zeros(len(a), bool)
        out[_survivors(a, b, least)] = True
        return pd.Series(out)

    return F.pandas_udf(run, "boolean")


def _tile(percent: int):
    """Links (a, b) that join components of a tile's members; exact on the sets of
    shingle hashes."""
    least = least_matches(percent / 100)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").reset_index(drop=True)
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES)
        bands = np.array(rows["bands"].tolist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size, ids = np.array([len(x) for x in sets]), rows["id"].to_numpy()
        part, band = rows["part"].to_numpy(), int(rows["band"].iloc[0])
        component, links = np.unique(rows["label"].to_numpy(), return_inverse=True)[1], []
        two = rows["ti"].iloc[0] != rows["tj"].iloc[0]
        for i in range(len(rows)):
            keep = component[i + 1 :] != component[i]
            if two:
                keep &= part[i + 1 :] != part[i]
            keep &= 100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])
            other = np.flatnonzero(keep) + i + 1
            if band and len(other):
                other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
            if not len(other):
                continue
            for j in other[_survivors(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], least)]:
                if component[i] == component[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    component[component == component[j]] = component[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _shingle_set(text: str) -> set[bytes]:
    words = words_of(text)
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def confirmed(percent: int):
    """The exact test on full sets."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, a = [], None, set()
        for x, y in zip(left, right):
            if x != last:
                a, last = _shingle_set(x), x
            b = _shingle_set(y)
            both = len(a & b)
            out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b). Rows (id, label): the smallest id reachable, for every id in an
    edge. Large-star and small-star steps keep the number of edges bounded."""
    state = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    while True:
        # Large star: larger neighbours of u link to the least of u and its neighbours.
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both, least, ["u"], ["v"], salts=SALTS).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours link to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], ["v"], salts=SALTS).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = materialise(small, "cc")
        same = after.exceptAll(state).isEmpty() and after.count() == state.count()
        discard(state)
        state = after
        if same:
            break
    return state.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _texts_of(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of class representatives; rows that repeat a doc_id with other words
    belong to another class and stay out."""
    # Written, as it is read for the filter too: of the texts, only candidates' are shuffled.
    known = materialise(reps.select("id", "rep", "cls").join(ids, "id"), "near-known")
    texts = likely(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", known).join(known, "rep")
    return texts.filter(F.pandas_udf(_in_class, "boolean")("text", "cls")).select("id", "text").dropDuplicates(["id"])


def _confirm(alive: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets of words."""
    ids = alive.select(F.col("a").alias("id")).unionByName(alive.select(F.col("b").alias("id"))).distinct()
    wanted = materialise(_texts_of(ids, reps, docs), "near-texts")
    # A pivot's pairs are dealt over salts, and its text goes to those that it has.
    salt = F.pmod(F.xxhash64("b"), F.lit(PIVOT_SALTS)).cast("int")
    right = alive.withColumn("_salt", salt).join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    left = alive.select("a", salt.alias("_salt")).distinct().join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = materialise(right.join(left, ["a", "_salt"]).filter(confirmed(percent)("text_a", "text_b")).select("a", "b"), "near-links")
    discard(wanted)
    return links


def _pivot_links(banded: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links of each bucket's members with its smallest."""
    heads = banded.groupBy("band", "key").agg(F.min("id").alias("a"))
    pairs = materialise(salted_join(banded, heads, ["band", "key"], ["id"]).filter("a <> id").select("a", F.col("id").alias("b")).distinct(), "near-pairs")
    a, b = pairs.select("a").distinct(), pairs.select("b").distinct()
    first = a.join(likely(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a", a), "a")
    second = likely(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b", b)
    sigs = salted_join(pairs.join(second, "b"), first, ["a"], ["b"])
    alive = materialise(sigs.filter(plausible(percent)("sig_a", "sig_b")).select("a", "b"), "near-alive")
    links = _confirm(alive, reps, docs, percent)
    discard(pairs, alive)
    return links


def _tile_links(banded: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links within the buckets that still have several components."""
    # Buckets of two were settled by their pivot.
    labelled = banded.filter("size > 2").join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("label", F.coalesce("label", "id")).drop("_id")
    several = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band", "key")
    members = materialise(salted_join(labelled, several, ["band", "key"], ["id"]), "near-open")
    ids = materialise(members.select("id").distinct(), "near-ids")
    texts = _texts_of(ids, reps, docs).select("id", F.pandas_udf(_hashes, "binary")("text").alias("shingles"))
    sets = materialise(texts.join(likely(reps.select("id", "sig", "bands"), "id", ids), "id"), "near-sets")
    parts = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES))
    placed = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiled = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(
        "id", "label", "band", "key", "part", F.least("part", "o").alias("ti"), F.greatest("part", "o").alias("tj")
    )
    alive = materialise(tiled.join(sets, "id").groupBy("band", "key", "ti", "tj").applyInPandas(_tile(percent), "a bigint, b bigint").distinct(), "near-alive")
    links = _confirm(alive, reps, docs, percent)
    discard(members, ids, sets, alive)
    return links


def _class_of(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else xxhash.xxh3_128_digest(b" ".join(words_of(t))) for t in text], dtype=object)


def _in_class(text: pd.Series, cls: pd.Series) -> pd.Series:
    return pd.Series([x == c for x, c in zip(_class_of(text), cls)], dtype=bool)


def _labelled(known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """known: rows (doc_id, text) with doc_id. Rows (doc_id, cls, n_shingles,
    component_id), and the doc_ids that occur with several sequences of words."""
    features = materialise(known.mapInPandas(_features(rows_a_band(percent)), FEATURES), "near-features")
    classes = features.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    member = salted_join(features, classes.drop("n"), ["cls"], ["doc_id"], "left", SALTS).withColumn("rep", F.coalesce("rep", "doc_id"))
    member = materialise(member, "near-members")
    twice = materialise(features.groupBy("doc_id").agg((F.max(F.struct("cls")) != F.min(F.struct("cls"))).alias("several")).filter("several").select("doc_id"), "near-twice")
    discard(features)
    # A class goes by its smallest doc_id, or by a hash where another class has that too.
    unique = twice.isEmpty()
    shared = twice.select(F.col("doc_id").alias("rep"), F.lit(True).alias("_shared"))
    node = F.when(F.col("_shared"), F.xxhash64("rep", "cls")).otherwise(F.col("rep"))
    numbered = lambda df: df.withColumn("id", F.col("rep")) if unique else df.join(shared, "rep", "left").withColumn("id", node).drop("_shared")
    reps = member.filter("cls is not null and doc_id = rep").select("rep", "cls", "sig", "bands", "n_shingles").dropDuplicates(["rep", "cls"])
    reps = materialise(numbered(reps), "near-reps")

    banded = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).filter("size > 1")
    banded = materialise(salted_join(banded.drop("n_shingles"), buckets, ["band", "key"], ["id"]), "near-buckets")

    links = _pivot_links(banded, reps, known, percent)
    labels = components(links)
    more = _tile_links(banded, labels, reps, known, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    rows = numbered(member.select("doc_id", "cls", "rep", "n_shingles"))
    rows = salted_join(rows, labels, ["id"], ["doc_id"], "left", SALTS).withColumn("label", F.coalesce("label", "id"))
    if unique:  # a label is its component's smallest doc_id
        named = rows.withColumn("component_id", F.col("label"))
    else:
        least = rows.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = salted_join(rows, least, ["label"], ["doc_id"], salts=SALTS)
    # Without words there is no link, so such a row is a component alone.
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", "cls", "n_shingles", own.alias("component_id")), twice


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    # Null ids stay out of the search: pandas would turn the column into doubles.
    named = _labelled(rows.filter("doc_id is not null"), percent)[0].drop("cls")
    blank = rows.filter("doc_id is null").mapInPandas(_sizes, "n_shingles bigint").select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return named.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"n_shingles": [len(shingle_hashes(words_of(t))) for t in batch["text"]]}, dtype="int64")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are their component's smallest doc_id, with all columns;
    rows without doc_id stay."""
    rows = boxed(docs, _id=column(docs, "doc_id", "bigint"), _text=text_or_empty(docs))
    named, twice = _labelled(rows.filter("_id is not null").select(F.col("_id").alias("doc_id"), F.col("_text").alias("text")), STAGE_PERCENT)
    gone = named.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls")).distinct()
    if twice.isEmpty():
        return unboxed(rows.join(gone.drop("_cls"), "_id", "left_anti"), docs)
    # Of rows with one doc_id and several texts, each goes by its own words.
    marked = rows.join(twice.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several")), "_id", "left")
    classed = marked.withColumn("_cls", F.pandas_udf(_class_of, "binary")(F.when(F.col("_several"), F.col("_text"))))
    several = twice.select(F.col("doc_id").alias("_id"))
    one, many = gone.join(several, "_id", "left_anti").select("_id"), gone.join(several, "_id", "left_semi")
    return unboxed(classed.join(one, "_id", "left_anti").join(many, ["_id", "_cls"], "left_anti"), docs)


def op5_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

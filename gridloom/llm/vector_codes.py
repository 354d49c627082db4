"""Product-quantised vector codes by Lloyd rounds that are maintained by differences.

Vectors become whole numbers and are cut into PARTS equal parts, each with a codebook of up
to ENTRIES entries. A round assigns every part to its nearest entry in a narrow pass and
writes the assignments beside those of the round before. Only parts whose assignment changed
contribute to the shuffle: plus their numbers for the new entry, minus them for the old one,
summed within each task first, so a task sends at most one row an entry. The running sums
are a table of PARTS * ENTRIES * (dimension / PARTS + 1) numbers that each round adds its
differences to. Only the codebooks, whose size does not depend on the rows, reach the driver
and go to the tasks.

All arithmetic is on whole numbers: distances by matrix products in double precision
where these are exact (all partial results below 2^53), in 64-bit integers otherwise.

Edge cases: a row whose vector is null, or holds a null, NaN or infinity, is dropped; so is
one whose length is no positive multiple of PARTS or differs from that of the kept row
that comes first; components whose whole number lies beyond +-2^24 count as +-2^24, so that
sums stay within a long; a null vec_id is kept and comes last; of rows that repeat a
vec_id each counts and is returned, in the order of their vectors; fewer than ENTRIES
rows make as many entries; null labels are one group, and its error stops at the largest
long; without kept rows there is no result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, materialise, salted_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 24
LONGEST = (1 << 63) - 1


def _numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept rows, their vectors as a binary of 32-bit numbers above -LIMIT, high byte
    first, so that binaries are in the order of their vectors."""
    for batch in batches:
        vectors = batch.column("v")
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False))])
        good = (sizes > 0) & (sizes % PARTS == 0) & (bad[ends] == bad[ends - sizes])
        numbers = _numbers(np.where(np.isfinite(values), values, 0))
        q = [(numbers[e - s : e] + LIMIT).astype(">u4").tobytes() if ok else None for e, s, ok in zip(ends, sizes, good)]
        out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(q, pa.binary())], ["vec_id", "label", "q"])
        yield out.filter(pa.array(good))


def _rows(q: pa.Array) -> np.ndarray:
    """(rows, PARTS, dimension / PARTS) from binaries of equal length."""
    return np.frombuffer(b"".join(q.to_pylist()), ">u4").astype(np.int64).reshape(len(q), PARTS, -1) - LIMIT


def nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows (n, PARTS, d), books (PARTS, k, d): indices of the nearest entries, the lower
    of equally near ones, and squared distances, both (n, PARTS)."""
    n, parts, d = rows.shape
    top = int(max(np.abs(rows).max(initial=0), np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * d * top * top < 1 << 53 else np.int64
    index, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        x, c = rows[:, p].astype(kind), books[p].astype(kind)
        far = (c * c).sum(axis=1) - 2 * (x @ c.T)
        index[:, p] = far.argmin(axis=1)
        error[:, p] = far[np.arange(n), index[:, p]] + (x * x).sum(axis=1)
    return index, error


def _assign(books: np.ndarray) -> Callable:
    """Rows with their new codes (a byte a part) and the codes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, _ = nearest(_rows(batch.column("q")), books)
                codes = pa.array([x.tobytes() for x in index.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "q")), codes, batch.column("codes")], ["vec_id", "label", "q", "codes", "before"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows with a changed part: for each entry the change of its count,
    then of its sums."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _rows(batch.column("q"))
        n, _, d = rows.shape
        total = np.zeros((PARTS, ENTRIES, d + 1), np.int64) if total is None else total
        new = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, PARTS)
        known = batch.column("before").is_valid().to_numpy(zero_copy_only=False)
        old = np.frombuffer(b"".join(x or bytes(PARTS) for x in batch.column("before").to_pylist()), np.uint8).reshape(n, PARTS)
        for p in range(PARTS):
            changed = ~known | (new[:, p] != old[:, p])
            value = np.concatenate([np.ones((n, 1), np.int64), rows[:, p]], axis=1)
            np.add.at(total[p], new[changed, p], value[changed])
            np.subtract.at(total[p], old[changed & known, p], value[changed & known])
    if total is not None:
        part, entry = np.nonzero(total.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "change"])


def _updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Floored means of the entries that are used; PARTS * ENTRIES rows at most."""
    out = books.copy()
    for part, entry, total in sums.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("t")).collect():
        count, *numbers = (t["total"] for t in total)
        if count:
            out[part, entry] = [x // count for x in numbers]
    return out


def _scored(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, error = nearest(_rows(batch.column("q")), books)
                codes = pa.array([x.tobytes().hex() for x in index.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """vectors: vec_id, label and an array of doubles v. The kept rows (vec_id, label, q,
    codes of the last round) and the codebooks (PARTS, entries, dimension / PARTS); None
    without kept rows."""
    kind = vectors.schema["label"].dataType.simpleString()
    kept = materialise(vectors.mapInArrow(_quantise, f"vec_id bigint, label {kind}, q binary"), "codes-kept")
    # The first rows decide on the length; they are as many as a codebook has entries.
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return None
    kept = kept.filter(F.length("q") == len(first[0]["q"]))
    start = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["q"]) for r in kept.orderBy(*order).limit(ENTRIES).select("vec_id", "q").collect())
    books = _rows(pa.array([q for _, _, q in start])).swapaxes(0, 1).copy()
    rows, sums = kept.withColumn("codes", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        assigned = materialise(rows.mapInArrow(_assign(books), f"vec_id bigint, label {kind}, q binary, codes binary, before binary"), "codes-assigned")
        moved = assigned.filter("before is null or before <> codes").select("q", "codes", "before").mapInArrow(_differences, "part int, entry int, change array<bigint>")
        change = moved.select("part", "entry", F.posexplode("change").alias("pos", "total"))
        both = change if sums is None else sums.unionByName(change)
        after = materialise(both.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")), "codes-sums")
        books = _updated(books, after)
        discard(rows, *([sums] if sums is not None else []))
        rows, sums = assigned, after
    return rows.drop("before"), books


def listing(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


REPORT = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """A row for each kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    v = column(vectors, "embedding", "array<double>")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string")
    trained = train(vectors.select(column(vectors, "vec_id", "bigint").alias("vec_id"), label.alias("label"), v.alias("v")), rounds)
    if trained is None:
        return vectors.sparkSession.createDataFrame([], REPORT)
    rows, books = trained
    kind = rows.schema["label"].dataType.simpleString()
    scored = materialise(rows.mapInArrow(_scored(books), f"vec_id bigint, label {kind}, code string, error bigint"), "codes-scored")
    discard(rows)
    keyed = scored.select("*", F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")
    by_label = keyed.groupBy("_none", "_label").agg(total.alias("label_error"))
    joined = salted_join(keyed, by_label, ["_none", "_label"], ["vec_id"])
    digest = hashlib.sha256(listing(books).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds unrolled: each assigns by least (distance, index) and takes floored means."""
    distance = "list_sum(list_transform(list_zip(q.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"at{r} AS MATERIALIZED (SELECT q.vec_id, q.p, min(struct_pack(d := {distance}, e := b.e)) AS m FROM parts q JOIN book{r} b USING (p) GROUP BY q.vec_id, q.p)")
        if r < ROUNDS:
            steps.append(
                f"""mean{r} AS (SELECT p, e, list(f ORDER BY i) AS v FROM (SELECT q.p, m.e AS e, i, CAST(floor(sum(q.v[i + 1]) / count(*)) AS BIGINT) AS f
FROM parts q JOIN at{r} a ON q.vec_id = a.vec_id AND q.p = a.p, range(CAST((SELECT max(len(v)) FROM parts) AS BIGINT)) t(i) GROUP BY q.p, m.e, i) GROUP BY p, e)"""
            )
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    return f"""WITH {", ".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM at{ROUNDS} GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes c JOIN kept k USING (vec_id)"""


ORACLE_SQL = {"op12_delta_lloyd": _oracle()}

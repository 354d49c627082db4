"""Substring dedup by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of one document; a repeat is a window whose words also
start in a document with a smaller doc_id.

1. Every window has an anchor, its least-hashed gram of GRAM words, so equal windows have
   equal anchors at equal places and the suffixes that start at anchors (about one word in
   five) are enough. A sparse tree of these, with the words before each, sees every window.
2. Anchors that occur in one document only are dropped. Tasks first combine equal anchors of
   the documents they hold, so a frequent one is sent once for each such block.
3. The suffixes left are split by variable-length prefixes. Prefixes of GRAM words that are
   not crowded share groups of bounded size; a group's suffixes, with their words, go to one
   task, which builds the subtree (sorted suffixes and their common lengths). Its internal
   nodes at least WINDOW - k deep, split by the k words before the suffix, are the repeated
   windows. Suffixes of a prefix with more than CROWDED of them are replaced by those that
   start at their windows, and split by longer prefixes, up to the whole window.
4. A prefix that is as long as the window and still crowded needs no subtree: it is a node of
   the tree itself. Its smallest doc_id comes from a combined minimum, and its suffixes are
   joined to that in salted parts.
5. Repeats of a document in a row make up its maximal repeated stretches.

Words are compared as words; hashes only choose anchors and drop suffixes that cannot
repeat. No count or list of documents reaches the driver but numbers of groups.

Edge cases: null, empty or blank text has no words, one with fewer than WINDOW words no
window: nothing is removed; rows with a null doc_id have no order, so they neither
lose words nor take any from others; rows that repeat a doc_id do not take words from each
other, each loses what a smaller doc_id has; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, materialise, salted_join, table, text_or_empty, union_all

WINDOW, GRAM = 13, 5
#: Places of an anchor within its window.
PLACES = WINDOW - GRAM + 1
#: Suffixes of one prefix, and of the prefixes that share a group: a task needs about a
#: kilobyte for each.
CROWDED, GROUP = 100_000, 50_000
#: Words of the prefixes tried where GRAM words are too few.
LENGTHS = ((GRAM + WINDOW) // 2, WINDOW)
SALTS = 32
#: Suffixes that a task sends on at a time.
ROWS = 50_000
#: Anchors of a block that are combined in a task, and characters of text behind a bucket.
BLOCK, BUCKET_CHARS = 1 << 20, 1 << 22

_MULTIPLY = np.random.default_rng(20240611).integers(1, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ANCHOR = np.dtype([("hash", "<u4"), ("key", "<i8")])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes, and the first and last window start of each."""
    n = len(words) - GRAM + 1
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = h[:n] * _MULTIPLY[0]
    for j in range(1, GRAM):
        total = _mix(total) + h[j : j + n] * _MULTIPLY[j]
    total = _mix(total)
    # Windows in a row keep their anchor until it leaves or a smaller one comes.
    place = np.arange(len(words) - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(total, PLACES).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[first]
    return at, total[at], first, np.append(first[1:], len(place)) - 1


def _blocks(buckets: int, block: int):
    """Rows (bucket, kind, data): anchors of a block by the bucket of their hash; those of
    two documents of the block (kind 1) are known to repeat, of these one goes on in search
    of others (kind 0)."""

    def flush(found: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        rows = np.empty(sum(len(h) for _, h in found), [("bucket", "<u4"), *ANCHOR.descr])
        h = np.concatenate([h for _, h in found])
        rows["bucket"], rows["hash"] = (h >> np.uint64(32)) % np.uint64(buckets), h & np.uint64(0xFFFFFFFF)
        rows["key"] = np.repeat([k for k, _ in found], [len(h) for _, h in found])
        rows = rows[np.lexsort((rows["key"], rows["hash"], rows["bucket"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["bucket"][1:] != rows["bucket"][:-1])
        again = np.zeros(len(rows), bool)
        other = ~new[1:] & (rows["key"][1:] != rows["key"][:-1])
        group = np.cumsum(new) - 1
        again[1:] = other
        several = np.bincount(group, weights=again) > 0
        kinds = ((0, new & ~several[group]), (1, several[group]), (2, new & several[group]))
        for kind, chosen in kinds:
            part = rows[chosen]
            edges = np.flatnonzero(np.diff(part["bucket"].astype(np.int64), prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(part))):
                yield int(part["bucket"][a]), kind, part[["hash", "key"]][a:b].astype(ANCHOR).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        frame = lambda rows: pd.DataFrame(rows, columns=["bucket", "kind", "data"])
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                h = np.unique(anchors(words_of(text))[1])
                if len(h):
                    found.append((key, h))
                    held += len(h)
                if held >= block:
                    yield frame(flush(found))
                    found, held = [], 0
        if found:
            yield frame(flush(found))

    return run


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """Anchors of a bucket that two documents hold: rows (key, hashes)."""
    parts = {k: np.concatenate([np.frombuffer(x, ANCHOR) for x in rows["data"][rows["kind"] == k]] or [np.zeros(0, ANCHOR)]) for k in range(3)}
    one = np.concatenate([parts[0], parts[2]])
    _, group, size = np.unique(one["hash"], return_inverse=True, return_counts=True)
    alone = np.arange(len(one)) < len(parts[0])
    out = np.concatenate([one[(size[group] > 1) & alone], parts[1]])
    out = out[np.argsort(out["key"], kind="stable")]
    edges = np.flatnonzero(np.diff(out["key"], prepend=out["key"][0] - 1)) if len(out) else []
    data = [out["hash"][a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(out)))] if len(out) else []
    return pd.DataFrame({"key": out["key"][edges] if len(out) else np.zeros(0, np.int64), "hashes": data})


SUFFIX = "key bigint, doc_id bigint, at int, few int, many int, before string, after string"


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The suffixes at anchors that may repeat: the words of their window and up to few to
    many (both included) words before."""
    names = ["key", "doc_id", "at", "few", "many", "before", "after"]
    for batch in batches:
        out: list[tuple] = []
        for key, doc_id, text, hashes in zip(batch["key"], batch["doc_id"], batch["text"], batch["hashes"]):
            words = words_of(text)
            at, h, first, last = anchors(words)
            wanted = np.unique(np.frombuffer(b"".join(hashes), "<u4"))
            keep = np.flatnonzero(np.isin((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), wanted))
            for a, f, m in zip(at[keep].tolist(), first[keep].tolist(), last[keep].tolist()):
                out.append((key, doc_id, a, a - m, a - f, b" ".join(words[f:a]).decode(), b" ".join(words[a : a + WINDOW]).decode()))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)


def _codes(texts: pd.Series, width: int, seen: dict[str, int], right: bool) -> np.ndarray:
    """(rows, width) word numbers; 0 where there is no word. right: last word last."""
    out = np.zeros((len(texts), width), np.int64)
    for row, text in zip(out, texts):
        codes = [seen.setdefault(w, len(seen) + 1) for w in text.split(" ")] if text else []
        if codes:
            row[width - len(codes) if right else 0 : None if right else len(codes)] = codes
    return out


def subtree_nodes(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes in the subtree and the number of words that each has in common
    with the one before it (-1 for the first). Nodes of depth d are the stretches whose
    common lengths are d or more; an end of text is no word and equals nothing."""
    order = np.lexsort(after.T[::-1])
    rows = after[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    common = np.where(same.all(axis=1), after.shape[1], same.argmin(axis=1))
    return order, np.concatenate([[-1], common])


def _subtree(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of a group's suffixes that start in a smaller doc_id too, as (key, at, found):
    bit k of found is the window that starts k words before at."""
    seen: dict[str, int] = {}
    after, before = _codes(rows["after"], WINDOW, seen, False), _codes(rows["before"], PLACES - 1, seen, True)
    order, common = subtree_nodes(after)
    docs = rows["doc_id"].to_numpy(np.int64)[order]
    few, many = rows["few"].to_numpy()[order], rows["many"].to_numpy()[order]
    before, found = before[order], np.zeros(len(rows), np.int64)
    left = np.zeros(len(rows), np.int64)
    for k in range(PLACES):
        if k:
            left = pd.factorize(left * (len(seen) + 1) + before[:, -k])[0]
        node = np.cumsum(common < WINDOW - k)
        here = np.flatnonzero((few <= k) & (k <= many))
        group = pd.factorize(node[here] * (len(rows) + 1) + left[here])[0]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, group, docs[here])
        found[here] |= (docs[here] > least[group]).astype(np.int64) << k
    hit = np.flatnonzero(found)
    return pd.DataFrame({"key": rows["key"].to_numpy()[order][hit], "at": rows["at"].to_numpy()[order][hit], "found": found[hit]})


FOUND = "key bigint, at int, found bigint"


def _windows(rows: DataFrame) -> DataFrame:
    """The windows of suffixes, each as the suffix of a window's words that starts there."""
    whole = F.split(F.concat_ws(" ", F.when(F.col("before") != "", F.col("before")), "after"), " ")
    spread = rows.select("key", "doc_id", "at", "many", whole.alias("w"), F.explode(F.sequence("few", "many")).alias("k"))
    after = F.array_join(F.slice("w", F.col("many") - F.col("k") + 1, F.lit(WINDOW)), " ")
    zero = F.lit(0)
    return spread.select("key", "doc_id", (F.col("at") - F.col("k")).alias("at"), zero.alias("few"), zero.alias("many"), F.lit("").alias("before"), after.alias("after"))


def _nodes(windows: DataFrame) -> DataFrame:
    """Repeated ones of the windows that are nodes themselves."""
    least = windows.groupBy("after").agg(F.min("doc_id").alias("least"))
    hit = salted_join(windows, least, ["after"], ["key", "at"], salts=SALTS).filter("doc_id > least")
    return hit.select("key", "at", F.lit(1).cast("bigint").alias("found"))


def _split(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows with their prefix of length words: those of prefixes that a task can hold, those
    of crowded ones (None if there are none), and the table of crowded prefixes."""
    rows = rows.withColumn("prefix", F.xxhash64(F.substring_index("after", " ", length)))
    sizes = rows.groupBy("prefix").agg(F.count("*").alias("n"))
    crowded = materialise(sizes.filter(F.col("n") > CROWDED).select("prefix", F.lit(True).alias("_crowded")), "substring-prefixes")
    if crowded.isEmpty():
        return rows, None, crowded
    # There are fewer crowded prefixes than rows / CROWDED; Spark broadcasts them below its
    # threshold only, and rows of one prefix are dealt over salts otherwise.
    marked = salted_join(rows, crowded, ["prefix"], ["key", "at"], "left", SALTS)
    return marked.filter("_crowded is null").drop("_crowded"), marked.filter("_crowded").drop("_crowded", "prefix"), crowded


def _found(suffixes: DataFrame) -> DataFrame:
    """Rows (key, at, found) of repeated windows; suffixes: a written table."""
    small, rest, crowded = _split(suffixes, GRAM)
    groups, spent = [(small, suffixes.count())], [crowded]
    if rest is not None:
        # Windows that share an anchor may go on differently after it, so longer prefixes
        # are those of the windows themselves.
        rest = materialise(_windows(rest), "substring-windows")
        spent.append(rest)
        size = rest.count()
        for length in LENGTHS:
            small, rest, crowded = _split(rest, length)
            groups.append((small, size))
            spent.append(crowded)
            if rest is None:
                break
    trees = [g.withColumn("group", F.pmod("prefix", F.lit(max(1, -(-n // GROUP))))).groupBy("group").applyInPandas(_subtree, FOUND) for g, n in groups]
    found = materialise(union_all([*trees, *([_nodes(rest)] if rest is not None else [])]), "substring-found")
    discard(*spent)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (key, doc_id, text): the key is the doc_id, or a hash of it and the text where
    rows of several texts have that doc_id."""
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    named = rows.filter("doc_id is not null")
    twice = materialise(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("_twice")), "substring-twice")
    if twice.isEmpty():
        return rows.withColumn("key", F.col("doc_id"))
    marked = salted_join(rows.withColumn("_t", F.xxhash64("text")), twice, ["doc_id"], ["_t"], "left").drop("_t")
    return marked.select(F.when(F.col("_twice"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("key"), "doc_id", "text")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (key, doc_id, text) of docs, and (key, starts): the first words of a
    document's repeated windows, as lists of rows (at, found)."""
    rows = _keyed(docs)
    named = rows.filter("doc_id is not null")
    chars = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + chars // BUCKET_CHARS
    blocks = named.select("key", "text").mapInPandas(_blocks(buckets, BLOCK), "bucket bigint, kind int, data binary")
    hashes = materialise(blocks.groupBy("bucket").applyInPandas(_repeated, "key bigint, hashes binary"), "substring-anchors")
    by_doc = hashes.groupBy("key").agg(F.collect_list("hashes").alias("hashes"))
    suffixes = materialise(named.join(by_doc, "key").select("key", "doc_id", "text", "hashes").mapInPandas(_suffixes, SUFFIX), "substring-suffixes")
    found = _found(suffixes)
    discard(hashes, suffixes)
    return rows, found.groupBy("key").agg(F.collect_list(F.struct("at", "found")).alias("starts"))


def covered(n: int, starts: list) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for at, found in starts:
        k = 0
        while found >> k:
            if found >> k & 1:
                edge[at - k] += 1
                edge[at - k + WINDOW] -= 1
            k += 1
    return np.cumsum(edge[:n]) > 0


def _pairs(starts) -> list[tuple[int, int]]:
    return [] if starts is None else [(s["at"], s["found"]) for s in starts]


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, starts in zip(batch["doc_id"], batch["text"], batch["starts"]):
            words = words_of(text)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered(len(words), _pairs(starts)).view(np.int8), [0]])))
            out += [(doc_id, a, b - a, b" ".join(words[a:b]).decode()) for a, b in edges.reshape(-1, 2).tolist()]
        yield pd.DataFrame(out, columns=["doc_id", "start", "length", "words"])


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """Each document's longest stretches of words that repeated windows cover: doc_id,
    start (word number), length, words."""
    rows, starts = repeats(docs)
    return rows.join(starts, "key").select("doc_id", "text", "starts").mapInPandas(_stretches, "doc_id bigint, start bigint, length bigint, words string")


REPORT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, starts in zip(batch["doc_id"], batch["text"], batch["starts"]):
            words = words_of(text)
            gone = covered(len(words), _pairs(starts)) if starts is not None else None
            kept = [w for w, x in zip(words, gone.tolist()) if not x] if gone is not None else words
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256."""
    rows, starts = repeats(docs)
    named = rows.filter("doc_id is not null").join(starts, "key", "left").select("doc_id", "text", "starts").mapInPandas(_kept, REPORT)
    # Null ids stay out of the search: pandas would turn the column into doubles.
    none = F.lit(None).cast("array<struct<at:int,found:bigint>>")
    blank = rows.filter("doc_id is null").select(F.lit(0).cast("bigint").alias("doc_id"), "text", none.alias("starts")).mapInPandas(_kept, REPORT)
    return named.unionByName(blank.withColumn("doc_id", F.lit(None).cast("bigint")))


def op11_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op11_suffix_tree_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM d, range(1, len(w) - {WINDOW - 2}) t(i) WHERE len(w) >= {WINDOW}),
least AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, i + o AS i FROM win JOIN least USING (k), range({WINDOW}) t(o) WHERE doc_id > least),
word AS (SELECT r, i, w[i] AS w FROM d, range(1, len(w) + 1) t(i)),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
}

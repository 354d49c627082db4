"""Substring dedup, vector codes and periodic runs against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import periodic_runs, substring_dedup, vector_codes

SCHEMA = "doc_id long, text string, key long, at int, prefix string, v string, label string, n_words string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def multiset(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["straße", "水"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, out = [prose(rng.randint(13, 60)) for _ in range(6)], []
    for i in range(150):
        text = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(passages)
            cut = rng.randrange(len(part))
            at = rng.randint(0, len(text))
            text[at:at] = part[cut:] if rng.random() < 0.3 else part
        out.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    out += [(200 + i, out[3][1]) for i in range(40)]  # copies
    out += [(None, out[5][1]), (None, None), (300, None), (301, ""), (302, " \n "), (303, "one two"), (7, out[7][1]), (7, out[3][1]), (8, " ".join(passages[0])), (8, " ".join(passages[0]))]
    out.append((400, " ".join(prose(30_000) + passages[1])))
    return [(i, t, 1, 2, "p", "v", "l", "n") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def brute_removal(rows):
    least = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            if i is not None:
                least[k] = min(i, least.get(k, i))
    out = collections.Counter()
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for j in range(len(w) - 12):
            if i is not None and least[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        out[i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    return out


@pytest.mark.parametrize("crowded, group, block", [(8_000, 30_000, 1 << 20), (3, 50, 40), (20, 10, 1)])
def test_substring_dedup(docs, rows, monkeypatch, crowded, group, block):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", 20_000)
    assert multiset(substring_dedup.report(docs)) == brute_removal(rows)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    for n in (12, 13, 14, 200):
        w = [rng.choice("abc").encode() for _ in range(n)]
        at, h, first, last = substring_dedup.anchors(w)
        place = {s: a - s for a, f, m in zip(at, first, last) for s in range(f, m + 1)}
        assert sorted(place) == list(range(n - 12))
        seen = {}
        for s, o in place.items():
            assert 0 <= o < substring_dedup.PLACES and seen.setdefault(tuple(w[s : s + 13]), o) == o


def test_subtree_nodes_are_common_prefixes():
    rng = np.random.default_rng(4)
    after = rng.integers(1, 3, (60, 5))
    after[::7, 3:] = 0
    order, common = substring_dedup.subtree_nodes(after)
    rows = after[order].tolist()
    assert rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], common[1:].tolist()):
        both = 0
        while both < 5 and a[both] == b[both] and a[both]:
            both += 1
        assert n == both


def test_maximal_repeats(spark):
    a, b, c = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 20), ("b", 15), ("c", 13)))
    df = spark.createDataFrame([(1, " ".join(a + ["x"] + b)), (2, " ".join(["y"] + a + c)), (3, " ".join(c[:12] + b + c)), (4, " ".join(a[:12]))], "doc_id long, text string")
    assert multiset(substring_dedup.maximal_repeats(df)) == {(2, 1, 20, " ".join(a)): 1, (3, 12, 28, " ".join(b + c)): 1}


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for out in (substring_dedup.report(empty), substring_dedup.maximal_repeats(empty), periodic_runs.report(empty), vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert out.count() == 0


def brute_codes(vectors, rounds=4):
    kept = sorted(((i is None, i or 0, [max(-(1 << 24), min(1 << 24, math.floor(1024 * x))) for x in v], i, label) for i, v, label in vectors if v and None not in v and all(map(math.isfinite, v))), key=lambda r: r[:3])
    kept = [r for r in kept if len(r[2]) == len(kept[0][2]) and len(r[2]) % 4 == 0]
    n = len(kept[0][2]) // 4
    cut = [[r[2][p * n : p * n + n] for p in range(4)] for r in kept]
    books = [[x[p] for x in cut[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            members = collections.defaultdict(list)
            for x in cut:
                members[near(x[p], books[p])[1]].append(x[p])
            for e, xs in members.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    digest = sha(",".join(str(x) for book in books for c in book for x in c))
    got = [[near(x[p], books[p]) for p in range(4)] for x in cut]
    errors = [sum(d for d, _ in g) for g in got]
    total = collections.Counter()
    for r, e in zip(kept, errors):
        total[r[4]] += e
    return collections.Counter((r[3], "".join(f"{e:02x}" for _, e in g), err, total[r[4]], digest) for r, g, err in zip(kept, got, errors))


@pytest.mark.parametrize("many", [40, 330])
def test_codes_against_brute_force(spark, many):
    rng = random.Random(many)
    vectors = [(i, [rng.gauss(i % 5, 1) for _ in range(8)], rng.choice([None, 0, 1, 2])) for i in range(many)]
    vectors += [(2 * i, vectors[i][1], 1) for i in range(10)]  # repeated ids, ties
    vectors += [(None, [0.5] * 8, 3), (900, None, 1), (901, [], 1), (902, [None] * 8, 1), (903, [math.nan] + [0.0] * 7, 2), (904, [math.inf] + [0.0] * 7, 2), (905, [1.0] * 4, 0), (906, [1.0] * 6, 0), (907, [1e30, -1e30] * 4, 0)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<double>, label int, q string, codes int").repartition(4)
    assert multiset(vector_codes.compress(df)) == brute_codes(vectors)


def test_only_changes_are_shuffled():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q = rng.integers(-50, 50, (100, 8)).astype(np.int64)
    old, new = rng.integers(0, 4, (100, 4)).astype(np.uint8), None
    new = old.copy()
    new[:9, 2] = (new[:9, 2] + 1) % 4
    binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    out = [r for b in vector_codes._differences([pa.RecordBatch.from_arrays([binary((q + vector_codes.LIMIT).astype(">u4")), binary(new), binary(old)], ["q", "codes", "before"])]) for r in b.to_pylist()]
    assert {r["part"] for r in out} == {2} and len(out) <= 4
    want = collections.defaultdict(lambda: np.zeros(3, int))
    for i in range(9):
        value = np.concatenate([[1], q[i].reshape(4, 2)[2]])
        want[new[i, 2]] += value
        want[old[i, 2]] -= value
    assert {r["entry"]: r["change"] for r in out} == {int(e): v.tolist() for e, v in want.items() if v.any()}


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_report(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark, docs, rows):
    rng = random.Random(5)
    more = [(1000 + i, " ".join(["a b c " * rng.randint(0, 9), "x " * rng.randint(0, 12), "p q " * rng.randint(0, 7)] * rng.randint(0, 6))) for i in range(60)] + [(2000, "same line here\n" * 300)]
    small = [r for r in rows if len(r[1] or "") < 20_000]
    df = docs.filter("text is null or length(text) < 20000").select("doc_id", "text", F.col("key").alias("period")).unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, period long"))
    got = multiset(periodic_runs.report(df))
    assert got == collections.Counter(brute_report(r[0], r[1]) for r in small + more)
    assert sum(r[1] > 0 for r in got) > 50


def test_runs_of_random_sequences():
    rng = random.Random(8)
    for _ in range(400):
        k, n, x = rng.choice([1, 2, 3, 9]), rng.randint(0, 90), []
        while len(x) < n:
            x += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 1, 5, 9])
        x = [f"{v}".encode() for v in x[:n]]
        assert periodic_runs.find_runs(periodic_runs.numbered(x)) == brute_runs(x)


@pytest.mark.parametrize("share", [0, 0.01, 1e9])
def test_lag_counts_of_frequent_and_rare_words(monkeypatch, share):
    monkeypatch.setattr(periodic_runs, "HEAVY", share)
    x = np.unique(np.random.default_rng(3).zipf(1.4, 3000) % 200, return_inverse=True)[1]
    counts = periodic_runs.lag_counts(x, 750)
    assert counts[1:].tolist() == [int((x[:-q] == x[q:]).sum()) for q in range(1, 751)]


def test_long_periodic_texts():
    n = 200_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic_runs.find_runs(np.arange(n) % 3) == [(0, n, 3)]
    x = np.arange(n) + 3
    x[50_000:170_000] = 3 + np.arange(120_000) % 9_000
    assert periodic_runs.find_runs(x) == [(50_000, 120_000, 9_000)]


def test_many_secrets_in_one_text(spark):
    """The frames over a text's matches grow with them, not with their square."""
    import time

    from gridloom.llm import secrets

    n = 50_000
    text = "\n".join(f"token=abcdefgh{i:06d} AKIAABCDEFGH{i:06d}" for i in range(n))
    start = time.time()
    row = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (n, n, 0)
    # Two frames that shrank took 62 s for 32,000 matches.
    assert time.time() - start < 60

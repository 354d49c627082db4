"""Edge cases and brute-force versions of the training-data operators."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, exact_dedup, hmm, language_id, mixing, near_dedup, packing, quality_rules, secrets, site_style_tree, warc_derivatives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, size string, target string, n_words string, row string, _gone string"
WORDS = {"en": "the and of to house tree water with river stone green under".split(), "de": "der und das nicht haus baum wasser fluss stein grün unter straße".split(), "fr": "le la et dans maison arbre eau rivière pierre verte sous été".split(), "es": "el los y en casa árbol agua río piedra verde bajo niño".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "en", "a"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(260):
        lang = rng.choice(list(WORDS))
        out.append((i, prose(rng, lang, rng.randint(20, 300)), lang, f"s{i % 3}"))
    base = out[0][1].split()
    for i in range(300, 330):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"edit{i}"
        out.append((i, " ".join(words), "en", "s0"))
    out += [(400, None, None, None), (401, "", "en", "s1"), (402, "  \n ", None, "s1"), (403, "ONE two", "en", None), (404, "one TWO", "en", None), (405, "!!! 123", "fr", "s2"), (406, out[5][1], "en", "s9"), (407, " ".join(w + "###" for w in prose(rng, "en", 200).split()), "en", "s0"), (None, "null id", "en", "s0"), (408, "the line here is the same one\n" * 40, "en", "s0"), (7, out[7][1], out[7][2], out[7][3])]
    return [(*r, 0, *(f"{name} of {r[0]}" for name in ("text", "size", "target", "words", "row", "gone"))) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def multiset(values):
    return collections.Counter(values)


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (quality_rules.judge(empty), packing.pack(empty, packing.default_tokenizer()), exact_dedup.copies(empty), exact_dedup.winners(empty), hmm.score(empty), near_dedup.near_duplicates(empty), language_id.identify(empty), secrets.report(empty), mixing.mix(empty), site_style_tree.extract(pages), warc_derivatives.derive(warc_derivatives.responses(pages))):
        assert out.count() == 0


def test_quality(docs, rows):
    got = collections.defaultdict(list)
    for r in quality_rules.judge(docs, min_group=60).collect():
        got[r["doc_id"]].append(r)
    for doc_id, text, *_ in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        for r in got[doc_id]:
            assert tuple(r[c] for c in quality_rules.BASE) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert not got[407][0]["kept"] and not got[407][0]["base_failed"] and len(got[7]) == 2
    clean = [r for d in range(260) for r in got[d] if not r["base_failed"]]
    assert all(r["kept"] for r in clean)


def test_quality_matches_numpy(docs):
    stats = quality_rules.base_counts(docs).select(*quality_rules._vector()).filter("z0 is not null").selectExpr("'' as _key", "*")
    z = np.array(stats.drop("_key").collect(), float)
    fit = quality_rules.fit_mcd(stats).first()
    floors = np.diag([(f * quality_rules.UNIT) ** 2 for f in quality_rules.FLOORS])

    def cut(d2):
        bins = np.floor(32 * np.log2(1 + d2)).astype(int)
        return z[bins <= np.sort(bins)[math.ceil(len(z) * quality_rules.H_SHARE) - 1]]

    def estimate(rows):
        m = rows.sum(0) / len(rows)
        return m, quality_rules.CONSISTENCY * (rows.T @ rows / len(rows) - np.outer(m, m)) + floors

    medians = [4 * np.sort(np.floor(z[:, j] / 4))[math.ceil(len(z) * 0.5) - 1] + 2 for j in range(4)]
    starts = []
    for first in (cut((((z - medians) / np.sqrt(np.diag(floors))) ** 2).sum(1)), z):
        starts.append(estimate(first))
    for _ in range(quality_rules.C_STEPS):
        was = [np.linalg.slogdet(k)[1] / 2 for _, k in starts]
        steps = [estimate(cut(((z - m) @ np.linalg.inv(k) * (z - m)).sum(1))) for m, k in starts]
        now = [np.linalg.slogdet(k)[1] / 2 for _, k in steps]
        starts = [b if y < x else a for a, b, x, y in zip(starts, steps, was, now)]
        if max(x - y for x, y in zip(was, now)) <= quality_rules.SETTLED:
            break
    best = min(((np.linalg.slogdet(k)[1], m, k) for m, k in starts), key=lambda x: x[0])
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            low[i, j] = fit[f"l{i}{j}"]
    assert np.allclose([fit[f"m{i}"] for i in range(4)], best[1]) and np.allclose(low @ low.T, best[2])


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    pieces = packing.pack(docs, path, block_tokens=5000).collect()
    full = Tokenizer.from_file(path)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, text, *_ in rows:
        if doc_id == 7:
            continue
        ids, at = np.array(full.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_best_fill_is_a_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        gap, sums = rng.randint(1, 80), {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        used = packing.best_fill(counts, gap)
        assert all(n <= counts[k] for k, n in used) and sum(k * n for k, n in used) == max(s for s in sums if s <= gap)


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = multiset((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    got = exact_dedup.copies(docs).collect()
    assert multiset((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.winners(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and kept.filter("doc_id = 7 or doc_id = 406").count() == 2


def test_exact_dedup_compares_content_where_digests_meet(docs, rows):
    # A digest of the length's parity: single texts share it with groups.
    parity = lambda text: (F.char_length(text) % 2).cast("string").cast("binary")
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    assert multiset(map(key, exact_dedup.copies(docs, parity).collect())) == multiset(map(key, exact_dedup.copies(docs).collect()))


def test_language_model(docs, rows):
    got = {r["doc_id"]: r for r in hmm.score(docs, states=4, iterations=3).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    low = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in low(r[1]))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text, *_ in rows:
        r, w = got[doc_id], low(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(doc_id), len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    test = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 3)]
    from itertools import product

    for text, got in zip(texts, m.log10_likelihood(texts)):
        total = sum(m.start[p[0]] * np.prod([m.moves[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, k] for s, k in zip(text, p)]) for p in product(range(3), repeat=len(text)))
        assert got == pytest.approx(math.log10(total))


def test_expected_counts_are_the_sums_over_paths(monkeypatch):
    from itertools import product

    monkeypatch.setattr(hmm, "SEGMENT", 2)
    monkeypatch.setattr(hmm, "LONG", 3)
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    texts = [rng.integers(0, 5, n) for n in (1, 7, 2, 3, 6)]
    counts, moved, starts, likelihood = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for text in texts:
        paths = list(product(range(3), repeat=len(text)))
        weights = np.array([m.start[p[0]] * np.prod([m.moves[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, k] for s, k in zip(text, p)]) for p in paths])
        likelihood += np.log(weights.sum())
        for p, w in zip(paths, weights / weights.sum()):
            starts[p[0]] += w
            for s, k in zip(text, p):
                counts[s, k] += w
            for a, b in zip(p, p[1:]):
                moved[a, b] += w
    got = m.expected(np.concatenate(texts), np.concatenate([np.arange(len(t)) == 0 for t in texts]))
    assert np.allclose(got[0][:5], counts, atol=1e-4) and np.allclose(got[1], moved, atol=1e-4)
    assert np.allclose(got[2], starts, atol=1e-4) and got[3] == pytest.approx(likelihood, rel=1e-5)


def test_a_training_pass_holds_a_bounded_piece_of_its_tokens():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(2)
    m = hmm.Model.first(np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS), 8)
    texts = [rng.integers(0, hmm.SYMBOLS, n).astype(np.uint16) for n in [30_000, *rng.integers(1, 9000, 700)]]
    batch = pd.DataFrame({"symbols": [x.tobytes() for x in texts]})
    tracemalloc.start()
    (got,) = hmm._expectation(m)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    tokens = sum(map(len, texts))
    sums = got.filter(like="s").drop(columns="symbol").to_numpy()
    assert tokens > 3_000_000 and peak < 150
    # Expected counts add up to the tokens, moves to those after the first, starts to the texts.
    assert [sums[:-10].sum(), sums[-10:-2].sum(), sums[-2].sum()] == pytest.approx([tokens, tokens - len(texts), len(texts)], rel=1e-4)
    assert sums[-1, 0] / math.log(10) == pytest.approx(m.log10_likelihood(texts).sum(), rel=1e-5)


def test_near_duplicates(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = near_dedup._shingle_set(t or "")
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (label[r["doc_id"]], len(sets[r["doc_id"]]), label[r["doc_id"]] == r["doc_id"])
    assert label[404] == 403


def test_rows_that_repeat_an_id_with_other_words(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(5, a), (5, b), (6, near(a)), (3, near(b)), (9, near(c)), (9, c), (5, ""), (4, c + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 96, 5, True), (5, 96, 3, False), (6, 96, 5, False), (3, 96, 3, True), (9, 96, 4, False), (5, 0, 5, True), (4, 97, 4, True)}
    kept = {(r["doc_id"], r["text"]) for r in near_dedup.filter_stage(spark, docs, "").collect()}
    assert kept == {(5, a), (3, near(b)), (5, ""), (4, c + " more")}


def test_percent_is_a_parameter(spark):
    words = [f"w{i}" for i in range(104)]
    # One word changed in the middle: 95 of 105 shingles in common (90.5 %); two, 82 %.
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "x", *words[31:60], "y", *words[61:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).filter("kept").count() == 2
    assert near_dedup.near_duplicates(docs, 80).filter("kept").count() == 1


def test_tiles_link_like_all_pairs(monkeypatch, docs, rows):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    want = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    monkeypatch.setattr(near_dedup, "TILE", 256)
    assert want == {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}


def shuffled(spark) -> int:
    """Bytes that this session's tasks have shuffled so far."""
    for _ in range(2):  # the last task's figures are booked with the next one
        time.sleep(1.2)
        spark.range(1).count()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_near_duplicates_shuffle_the_texts_of_candidates_only(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(f" w{rng.randrange(10**6)}" for _ in range(4000)) for _ in range(200)]
    texts += [f"changed{i}{texts[i]}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "TILE", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert shuffled(spark) - before < sum(map(len, texts)) / 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i - 200 if i >= 200 else i for i in range(204)}


def test_likely_keeps_all_that_are_wanted(spark, monkeypatch):
    wanted = spark.range(0, 10_000, 7).unionByName(spark.range(-100, 0)).selectExpr("id AS k")
    rows = spark.range(-1000, 20_000).selectExpr("id AS k", "id % 5 AS other").unionByName(spark.createDataFrame([(None, 1)], "k long, other long"))
    want = {r["k"] for r in wanted.collect()}
    got = [r["k"] for r in common.likely(rows, "k", wanted).collect()]
    assert want <= set(got) and len(got) == len(set(got)) and len(got) - len(want) < 0.08 * 21_000
    assert common.likely(rows, "k", wanted.limit(0)).count() == 0
    monkeypatch.setattr(common, "BLOCKS", 4)  # too few: more of the others pass, but nothing is lost
    assert want <= {r["k"] for r in common.likely(rows, "k", wanted).collect()}


def test_language_id(docs, rows):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    test = [r for r in rows[:260] if got[r[0]]["held_out"]]
    assert len(test) > 40 and sum(got[r[0]]["lang_pred"] == r[2] for r in test) >= 0.95 * len(test)
    assert got[400]["lang_pred"] == got[405]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div id="cookie-notice">We use cookies</div>
<article><header><h1>Title {n}</h1></header><p>First &amp; <b>bold</b>   text {n}<p>Second&nbsp;one {n}<br>and more<!-- x --><form><input>Subscribe</form>
<div class="sharing">Share this</div></article><section class="comments"><p>nice page</p></section><aside>Side</aside><footer>&copy; me</footer></body></html>"""
SOUP = '<div class="top"><p>Welcome to the site</p></div><div class="body"><p>Story number {n} is here</p><p>It has {n} lines</p></div><div class="end"><p>Contact us</p></div>'


def test_extraction(spark):
    rows = [(i, "http://a.org/1", PAGE.format(n=i)) for i in range(3)] + [(10 + i, f"http://b.org/{i}", SOUP.format(n=i)) for i in range(12)] + [(50, None, None), (51, "http://c.org", "plain < 3 &lt;b&gt; text"), (52, "http://c.org", "<p>a<p><<<>b</"), (None, "x", "")]
    got = {r["page_id"]: r for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Title 1\nFirst & bold text 1\nSecond one 1\nand more"
    assert got[12]["text"] == "Story number 2 is here\nIt has 2 lines"
    assert got[50]["text"] == "" and got[51]["text"] == "plain < 3 <b> text" and all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(rows)


def test_extraction_keeps_marked_wrappers(spark):
    story = "<p>Story number {n} is told here at some length</p><p>and it has {n} lines more</p>"
    pages = {
        "http://w.org/1": f'<div id="page" class="sidebar has-sidebar"><p>Top</p>{story}</div>',
        "http://w.org/2": f'<div class="widget"><nav>Menu</nav><article class="post social">{story}</article></div>',
        "http://w.org/3": '<div class="notice"><p>All that there is</p></div><form>Send</form>',
        "http://w.org/4": f'<form>{story}</form><div class="sidebar">Side</div>',
        "http://w.org/5": f'<div>{story}</div><ol class="comments"><li><article>nice</article></ol>',
        "http://w.org/6": '<nav>Menu</nav>',
    }
    rows = [(i, url, page.format(n=i)) for i, (url, page) in enumerate(pages.items(), 1)]
    # A section's own box on few pages of a host with enough; one story under two addresses.
    box = '<div class="box"><p>See also our town guide</p></div>'
    rows += [(20 + i, f"http://t.org/{i}", f'<div class="body" id="b{i // 2}">{story}</div>{box if i < 8 else ""}'.format(n=i // 2)) for i in range(12)]
    rows += [(40 + i, f"http://m.org/{i}", f'<div id="all"><ul>{"".join(f"<li>Link {k}" for k in range(40))}</ul><div>{story}</div>{"<h6>Few pages have it</h6>" if i < 4 else ""}</div>'.format(n=i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    told = lambda n: f"Story number {n} is told here at some length\nand it has {n} lines more"
    assert [got[i] for i in range(1, 7)] == ["Top\n" + told(1), told(2), "All that there is", told(4), told(5) + "\nnice", "Menu"]
    assert all(got[20 + i] == told(i // 2) for i in range(12))
    assert all(got[40 + i] == told(i) for i in range(9))


def test_importance_against_brute_force(spark):
    rng = random.Random(4)
    pages = [f'<div class="a"><p>{rng.choice(["same", "one", "two"])}</p>{"<h2>t</h2>" if i % 3 else ""}</div><ul><li>x{i % 5}<li>y</ul>' for i in range(20)]
    got = {r["node"]: r for r in site_style_tree.importance(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()}
    shapes, texts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for page in pages:
        blocks, children = site_style_tree.read_page(page)
        below = collections.defaultdict(set)
        for node, text in blocks:
            for key in node.chain:
                below[key].add(text)
        for key, own in below.items():
            shapes[key][tuple(children.get(key, ()))] += 1
            texts[key].update(own)
    assert set(got) == set(shapes)
    for key, counts in shapes.items():
        n = sum(counts.values())
        presentation = -sum(c / n * math.log(c / n, n) for c in counts.values())
        content = 1 - sum(math.log(c, n) for c in texts[key].values()) / len(texts[key])
        weight = site_style_tree.GAMMA ** len(counts)
        assert got[key]["importance"] == pytest.approx((1 - weight) * presentation + weight * content)


def test_odd_markup(spark):
    plain = lambda page: site_style_tree.main_text(site_style_tree.read_page(page)[0], set())
    assert plain('foo <a href="x>bar baz') == "foo bar baz" and plain('<p class="a>b</p><p>c</p>') == "b\nc" and plain("a <b title='>'>c</b>") == "a c"
    deep = site_style_tree.read_page("".join(f"<div>a{i}" for i in range(3000)))[0]
    assert len(deep) == 3000 and max(len(n.chain) for n, _ in deep) == site_style_tree.DEEPEST


def test_trees_change_pages(spark):
    """The share of pages that the trees alone change, where a host repeats its boilerplate."""
    rows = [(i, f"http://b.org/{i}", SOUP.format(n=i)) for i in range(12)]
    text = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    changed = sum(text[i] != site_style_tree.main_text(site_style_tree.read_page(page)[0], set()) for i, _, page in rows)
    assert changed == len(rows)


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rows = [(i, f"{w} {w}er {w}ing text", w) for i in range(120) for w in [["alpha", "beta", "gamma", "rare1", "rare2"][min(i % 7, 4) if i % 40 == 6 else i % 3]]]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} <= {"alpha", "beta", "gamma"} and len(got) == len(rows)


def test_long_text(spark):
    """One text of half a million words passes every operator whole."""
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(500_000)) + " password=abcdefgh1"
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, long + " x", "en", "a"), (3, "short text here", "de", "b")], "doc_id long, text string, lang string, source string")
    judged = {r["doc_id"]: r["n_words"] for r in quality_rules.judge(docs).collect()}
    assert judged == {1: 500_001, 2: 500_002, 3: 3}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    pieces = packing.pack(docs, packing.default_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r["n"] == r["t"] for r in pieces) and len(pieces) == 3
    assert {r["doc_id"]: r["spans"] for r in secrets.report(docs).collect()}[1] == f"assign:{len(long) - 18}:{len(long)}"
    assert sum(r["n_tokens"] for r in hmm.score(docs, states=2, iterations=2).collect()) == 1_000_009
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}.keys() == {1, 2, 3}


def test_secrets(spark):
    texts = ["password = 'abcdefgh1' and token:short api-key x", "AKIA" + "B" * 12 + " " + "a1b2c3d4" * 4, "é" * 3 + "Api_Key: Zq9" + "x" * 9 + " https://host.example.org/path", "see https://clean.example.org", "client_id=web01 " + "Ab1" * 9, "Ab1" * 9 + " alone", "client_id=web01" + " y" * 400 + " " + "Ab1" * 9, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = collections.defaultdict(list)
    for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    assert len(got[0]) == 2 and (got[0][0]["n_assign"], got[1][0]["n_access"], got[1][0]["n_hex"]) == (1, 1, 1)
    assert got[2][0]["spans"] == "assign:3:24,endpoint:25:54" and got[3][0]["spans"] == "" and got[5][0]["spans"] == ""
    assert got[4][0]["spans"] == "id:0:15,key:16:43" and got[6][0]["spans"] == ""
    for i, t in enumerate(texts):
        found = []
        for k, kind in enumerate(secrets.BASE):
            pattern, group, least = secrets.KINDS[kind]
            found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
        assert got[i][0]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()


def test_linking_against_brute_force(spark):
    rng = random.Random(11)
    parts = ["client_id=web01", "Ab1" * 9, "https://host.example.org/path", "password=abcdefgh1", "AKIA" + "Q" * 14, "0123456789abcdef" * 2, "s3://bucket/key", "user: anna.b"]
    texts = ["".join(rng.choice(parts) + " " * rng.choice([1, 30, 399, 400, 401, 433]) + rng.choice(["", "filler words here "]) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        found = []
        for kind, (pattern, group, least) in secrets.KINDS.items():
            for m in re.finditer(pattern, text):
                if len(m[group]) >= least and (kind != "key" or all(re.search(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]"))):
                    found.append((m.start(), m.end(), kind))
        base = [x for x in found if x[2] in secrets.BASE]
        found = [x for x in found if x in base or not any(x[0] < b[1] and b[0] < x[1] for b in base)]
        gap = lambda x, y: max(y[0] - x[1], x[0] - y[1])
        kept = [x for x in found if x in base or any(secrets.ROLES[y[2]] in secrets.NEEDS[x[2]] and gap(x, y) <= secrets.SCOPE for y in found)]
        order = list(secrets.KINDS)
        assert got[i] == ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(kept, key=lambda x: (x[0], order.index(x[2])))), text


def test_bare_keys_are_whole_runs(spark):
    rng = random.Random(5)
    keys = ["kXvTqRbNmWzLpQsDfGhJ4a7C", "Kx-" * 9 + "1", "/kXvTqRbNmWzLpQsDfGhJ4a7C", "z" * 60 + "B9"]
    while len(keys) < 60:
        key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_") for _ in range(rng.choice([20, 24, 32, 40])))
        keys += [key] * all(re.search(p, key) for p in ("[A-Z]", "[a-z]", "[0-9]"))
    odd = ["kXvTqRbNmWzLpQsDfGhJ", "KXVT1" * 5, "kxvt1" * 5, "kXvTqRbNmWzLpQsDfG1"]
    rows = [(i, f"client_id=web01 {k} end") for i, k in enumerate(keys + odd)]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(keys))] == [f"id:0:15,key:16:{16 + len(k)}" for k in keys]
    assert all(got[i] == "" for i in range(len(keys), len(rows)))


def test_mix(docs, rows, spark):
    flat = lambda df: mixing.mix(df).select("doc_id", F.col("row.v3").alias("source"), "size", "source_size", "target", "copies").collect()
    got = flat(docs)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = rest / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * share > 2 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= above
    target |= {s: weight[s] * share for s in free}
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(300, 0.02 * target[s])
    again = flat(docs.repartition(7))
    assert multiset((r["doc_id"], r["copies"]) for r in got) == multiset((r["doc_id"], r["copies"]) for r in again)


def test_many_sources(spark):
    """Shares by code point and their cap, against the plain loop, on as many sources as rows."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), f"h{rng.randrange(10**6):06d}" if i % 9 else None) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free, rest = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(sizes.values())
    while above := {s for s in free if weight[s] * rest / sum(weight[x] for x in free) > 2 * sizes[s]}:
        target |= {s: 2 * sizes[s] for s in above}
        rest -= sum(2 * sizes[s] for s in above)
        free -= above
    target |= {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
    assert all(r["target"] == pytest.approx(target[rows[r["doc_id"]][2]]) for r in got)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "<html><head><title>x</title></head><p>A &amp; b</p><p>c</p>"), (2, None, None), (None, "u", "é")], "page_id long, url string, html string")
    source = warc_derivatives.responses(pages)
    made = warc_derivatives.derive(source)
    ids = {r["record_id"] for r in source.collect()}
    rows = made.collect()
    assert len(rows) == 6 and {r["refers_to"] for r in rows} == ids
    texts = {r["page_id"]: r["block"] for r in rows if r["record_type"] == "conversion"}
    assert texts == {1: "A & b\nc", 2: "", None: "é"}
    heads = {r["record_id"]: r["header"] for r in warc_derivatives.with_header(made).collect()}
    assert all(f"WARC-Refers-To: {r['refers_to']}\r\n" in heads[r["record_id"]] and heads[r["record_id"]].startswith("WARC/1.1\r\nWARC-Type: " + r["record_type"]) for r in rows)
    conversions = {r["refers_to"]: r["record_id"] for r in rows if r["record_type"] == "conversion"}
    assert all(conversions[r["refers_to"]] in r["block"] for r in rows if r["record_type"] == "metadata")
    back = warc_derivatives.parse(warc_derivatives.serialise(made)).collect()
    key = lambda r: (r["record_id"], r["refers_to"], r["target_uri"], r["payload_digest"], r["block"])
    assert sorted(map(key, back), key=str) == sorted(map(key, rows), key=str)
    assert all(r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() for r in back)


def test_warc_text_follows_its_rules():
    pieces = [" ", "\t", "\r", "\f", "\n", "a", "b", "\xa0", "\v", "<p>", "</p>", "<br>", "&amp;", "&lt;", "<!-- x -->", "<script>y</script>"]
    rng = np.random.default_rng(5)
    for _ in range(2000):
        page = text = "".join(rng.choice(pieces, rng.integers(0, 14)))
        for pattern, replacement in warc_derivatives.TEXT_RULES[:3]:
            text = re.sub(pattern, replacement, text)
        for name, value in warc_derivatives.ENTITIES.items():
            text = text.replace(name, value)
        for pattern, replacement in warc_derivatives.TEXT_RULES[3:]:
            text = re.sub(pattern, replacement, text)
        assert warc_derivatives._strip(page) == text


def test_warc_text_decodes_all_references(spark):
    import html

    texts = ["&eacute;t&eacute; &mdash; &hellip; it&#8217;s &#x2014; &apos;a&#039; &lt;b&gt; &amp;lt; &copy; &middot; &quot;", "a&nbsp;b&#160;&#xA0;c\u00a0d &unknown; & &#0; x&#10;&#10;y", "&amp;#39; &NotEqualTilde; &#128512;"]
    rows = [(i, "u", f"<p>{t}</p>") for i, t in enumerate(texts)]
    made = warc_derivatives.derive(warc_derivatives.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    got = {r["page_id"]: r["block"] for r in made if r["record_type"] == "conversion"}
    assert got == {0: html.unescape(texts[0]), 1: "a b c\u00a0d &unknown; & \ufffd x\ny", 2: html.unescape(texts[2])}
    facts = {r["page_id"]: r["block"] for r in made if r["record_type"] == "metadata"}
    assert all(f"characters: {len(got[i])}\r\n" in facts[i] and hashlib.sha256(got[i].encode()).hexdigest() in facts[i] for i in got)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, out, str(tmp_path))
        assert after.columns == out.columns, name
        after.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        # Whole rows survive, names that clash with the stages' own included.
        whole = lambda df: {tuple(r) for r in df.collect()}
        assert whole(out) <= whole(docs), name
    ids = {r[0] for r in out.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == ids and 407 not in ids and 400 not in ids

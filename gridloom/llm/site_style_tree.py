"""Main text of pages by site style trees.

A page is read into blocks of text, each with the path of its block elements (name,
id and class). The trees of a host's pages merge path by path:

- presentation importance of a node: the entropy, to the base of its pages, of the
  sequences of child elements that it has (1 on a single page);
- content importance of a branch: 1 less the mean, over its distinct texts, of the
  entropy of a text's occurrences over the pages, log(pages with it) / log(pages);
- importance: (1 - GAMMA^l) * presentation + GAMMA^l * content, for l presentations.

All blocks take part in the trees. A branch is noisy if it and all below it are below
LEAST; blocks of noisy branches are removed from each page of the host. A branch whose
pages all have the same text counts as one page. Elements that say what they are (nav,
aside, form, a whole class token, id or role such as `sidebar` or `comments`) are a prior:
they are no content unless they hold an article or main element or more than half of the
page's text. An article is the page's main text unless such an element holds it with less
than that. A host of fewer than MIN_PAGES pages has no estimate, and a page that would
lose all its text to any of the steps keeps it.

Counts are summed by host, path and text with partial aggregation, and pages of a hot
host are dealt over salts when they meet their host's list of branches.

Edge cases: a null html is empty and gives an empty text; a null url is a host of its own
with null paths joined to nothing; tag soup is read without failing; repeated pages count
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, materialise, salted_join, table

GAMMA, LEAST, MIN_PAGES = 0.9, 0.3, 8
#: Elements nested deeper count for the one at this depth, as in browsers.
DEEPEST = 512
SALTS = 8

# HTML element names by role and words of boilerplate classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr ins del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option button svg math iframe object canvas audio video head title".split())
NOISE = frozenset("nav aside footer form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies notice consent gdpr popup modal overlay share sharing social related recommended comment comments commentlist disqus respond reply replies newsletter subscribe signup login search searchbox pagination pager toolbar widget skip alert".split()
)
HEADERS = frozenset("header masthead topbar".split())

#: A tag whose quote is left open ends at its first >.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|$)|[^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""\b(id|class|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose start ends an open p, as in the HTML standard.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th"}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "option": ("select",)}


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class _Node:
    """key: a hash of the labels from the root to the element; chain: its key and those above
    it but the root's. marked: the element says that it is not content. holds: it is or
    holds a main or article element. size: characters of text below it. settle() gives
    noise and main."""

    __slots__ = ("name", "key", "chain", "parent", "marked", "own", "within", "holds", "size", "small", "noise", "main")

    def __init__(self, name: str, label: str, parent: "_Node | None", words: set[str]):
        self.name, self.parent, self.size = name, parent, 0
        if not parent:
            self.key, self.chain = 0, ()
        elif len(parent.chain) >= DEEPEST:
            self.key, self.chain = parent.key, parent.chain
        else:
            self.key = _hash(f"{parent.key}/{label}")
            self.chain = (self.key, *parent.chain)
        self.own = name == "main" or "main" in words
        self.holds = self.own or name in MAIN
        self.within = self.holds or bool(parent and parent.within)
        self.marked = name in NOISE or bool(words & NOISE_WORDS) or (not self.within and (name == "header" or bool(words & HEADERS)))


def _settle(nodes: list[_Node]) -> None:
    """nodes: parents before children."""
    for node in reversed(nodes):
        if node.parent:
            node.parent.size += node.size
            node.parent.holds |= node.holds
    total = nodes[0].size
    for node in nodes:
        up = node.parent
        little = node.marked and 2 * node.size <= total
        node.noise = bool(up and up.noise) or (little and not node.holds)
        node.small = bool(up and up.small) or little
        node.main = bool(up and up.main) or node.own or (node.name == "article" and not node.small)


def read_page(page: str) -> tuple[list[tuple[_Node, str]], dict[int, list[str]]]:
    """Blocks (node, text) in page order; labels of the children by key."""
    root = _Node("html", "html", None, set())
    nodes, stack, blocks, shapes, pending = [root], [root], [], {}, []

    def flush() -> None:
        if pending:
            text = " ".join(html_lib.unescape("".join(pending)).split())
            pending.clear()
            if text:
                stack[-1].size += len(text)
                blocks.append((stack[-1], text))

    def leave(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name in names:
                flush()
                del stack[at:]
                return
            if stack[at].name in scope:
                return

    at, end = 0, len(page)
    while at < end:
        tag = _TOKEN.search(page, at)
        if not tag:
            pending.append(page[at:])
            break
        if tag.start() > at:
            pending.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                pending.append(tag[0][9:].removesuffix("]]>"))
            continue
        if tag[1]:
            if name == "p" and not any(n.name == "p" for n in stack) or name == "br":
                flush()
            elif name not in INLINE and name not in ("html", "body"):
                leave((name,))
            continue
        if name in RAW:
            flush()
            if not tag[0].endswith("/>"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                # A head without its end lasts to the body.
                if not close and name == "head":
                    close = re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        attributes = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(tag[3])} if tag[3] else {}
        words = {w for v in ("id", "class", "role") for w in attributes.get(v, "").split()}
        if name in INLINE and not words & NOISE_WORDS:
            continue
        if name in VOID:
            flush()
            continue
        if name in ("html", "body"):
            continue
        if name in _ENDS_P:
            leave(("p",), ("button", "table", "td", "th"))
        if name in _SIBLINGS:
            leave(tuple(_SIBLINGS[name].split()), _SCOPES[name])
        flush()
        label = name + "".join(f"#{attributes['id']}" if k == "id" else "." + ".".join(sorted(attributes["class"].split())) for k in ("id", "class") if attributes.get(k))
        parent = stack[-1]
        node = _Node(name, label, parent, words)
        nodes.append(node)
        shape = shapes.setdefault(parent.key, [])
        if not shape or shape[-1] != label:
            shape.append(label)
        if not tag[0].endswith("/>"):
            stack.append(node)
    flush()
    _settle(nodes)
    return blocks, shapes


FEATURES = "host string, node bigint, kind int, value bigint, above binary, whole bigint"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A page's distinct rows: kind 0, a text of a node's branch; kind 1, the node's
    children, with the nodes above it."""
    for batch in batches:
        out = []
        for host, page in zip(batch["host"], batch["html"]):
            blocks, shapes = read_page(page)
            whole = _hash("\n".join(text for _, text in blocks))
            seen, used = set(), {}
            for node, text in blocks:
                value = _hash(text)
                for depth, key in enumerate(node.chain):
                    if (key, value) in seen:  # and so have all above it
                        break
                    seen.add((key, value))
                    used.setdefault(key, node.chain[depth + 1 :])
            out += [(host, key, 0, value, None, whole) for key, value in seen]
            out += [(host, key, 1, _hash("\t".join(shapes.get(key, ()))), struct.pack(f"<{len(above)}q", *above), whole) for key, above in used.items()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys_above(above: pd.Series) -> pd.Series:
    return above.map(lambda b: list(struct.unpack(f"<{len(b) // 8}q", b)))


def importance(pages: DataFrame) -> DataFrame:
    """Rows (host, node, above, pages, presentation, content, importance) of the merged trees."""
    rows = pages.filter("host is not null").select("host", "html").mapInPandas(_features, FEATURES)
    counts = rows.groupBy("host", "node", "kind", "value", "above").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    nodes = counts.groupBy("host", "node").agg(
        F.max("above").alias("above"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("pages"),
        F.count_if(F.col("kind") == 1).alias("l"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log(F.col("n").cast("double")))).alias("nlogn"),
        F.avg(F.when(F.col("kind") == 0, F.log(F.col("n").cast("double")))).alias("logdf"),
        (F.min("least") == F.max("most")).alias("same"),
    )
    log_m = F.log(F.col("pages").cast("double"))
    single = (F.col("pages") < 2) | F.col("same")
    presentation = F.when(single, F.lit(1.0)).otherwise(1 - F.try_divide(F.col("nlogn"), F.col("pages") * log_m))
    content = F.when(single, F.lit(1.0)).otherwise(1 - F.coalesce(F.try_divide(F.col("logdf"), log_m), F.lit(0.0)))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    return nodes.select("host", "node", "above", "pages", presentation.alias("presentation"), content.alias("content"), ((1 - weight) * presentation + weight * content).alias("importance"))


def noisy(pages: DataFrame) -> DataFrame:
    """Rows (host, node) of the noisy branches of hosts with enough pages."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
    nodes = importance(pages).join(hosts, "host", "left_semi")
    up = nodes.select("host", F.explode(F.concat(F.array("node"), _keys_above("above"))).alias("node"), "importance")
    return up.groupBy("host", "node").agg(F.max("importance").alias("best")).filter(F.col("best") < LEAST).select("host", "node")


def main_text(blocks: list[tuple[_Node, str]], low: set[int]) -> str:
    """low: the host's noisy branches. The trees come first; then a page that has an
    article or main element keeps to it, and marked elements go."""
    blocks = [b for b in blocks if b[0].key not in low] or blocks
    blocks = [b for b in blocks if b[0].main] or blocks
    blocks = [b for b in blocks if not b[0].noise] or blocks
    return "\n".join(text for _, text in blocks)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for page, low in zip(batch["html"], batch["low"]):
            low = set(low) if low is not None else set()
            texts.append(main_text(read_page(page)[0], low))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    url = column(pages, "url", "string")
    rows = pages.select(column(pages, "page_id", "bigint").cast("string").alias("page_id"), url.alias("url"), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    lists = materialise(noisy(rows).groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low")), "site-trees")
    joined = salted_join(rows, lists, ["host"], ["page_id", "url"], "left", SALTS)
    out = joined.select("page_id", "url", "html", "low").mapInPandas(_extract, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast("bigint"))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

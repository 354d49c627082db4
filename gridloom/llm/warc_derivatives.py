"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Every derived record points to its response by WARC-Refers-To, keeps the response's
target URI, date and payload digest, and has digests of its own block. The metadata
record names its conversion in turn, so the three are linked both ways. Records are
narrow DataFrame projections: no shuffle, and a lost task makes the same records again.
Record ids are name-based (from the response's id and the record's kind).

Edge cases: a null html is a response with an empty payload; its conversion is empty. A
null url gives records without target URI; a null page_id takes part in the id as an
empty name; repeated pages give repeated records; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, table

#: Date of records whose page table has none.
DATE = "2024-01-01T00:00:00Z"
# Character references that are replaced in this order. A text with any
# other reference is decoded as a whole by HTML's rules, a no-break space as a space.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: (pattern, replacement) that turn markup to text; blocks end lines.
TEXT_RULES = [
    (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<head[^>]*>.*?</head>", " "),
    (r"(?i)<(br|/p|/h[1-6]|/li|/div|/tr|/article|/section|/nav|/footer|/header)[^>]*>", "\n"),
    (r"(?s)<[^>]*>", " "),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


_MARKUP = [(re.compile(pattern), replacement) for pattern, replacement in TEXT_RULES[:3]]
#: A reference that is not one of ENTITIES as they are written there.
_OTHER = re.compile("&(?!(?:" + "|".join(e[1:-1] for e in ENTITIES) + ");)[#A-Za-z]")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _decode(text: str) -> str:
    if _OTHER.search(text):
        return _REFERENCE.sub(lambda m: html_lib.unescape(m[0]).replace("\xa0", ENTITIES["&nbsp;"]), text)
    for name, value in ENTITIES.items():
        text = text.replace(name, value)
    return text


def _strip(html: str) -> str:
    for pattern, replacement in _MARKUP:
        html = pattern.sub(replacement, html)
    text = _decode(html) if "&" in html else html
    # The rules for white space: lines of words with a space between, no empty lines.
    for space in "\t\r\f":
        text = text.replace(space, " ")
    lines = (" ".join(filter(None, line.split(" "))) for line in text.split("\n"))
    return "\n".join(filter(None, lines))


@F.pandas_udf(T.StringType())
def plain_text(html: pd.Series) -> pd.Series:
    """A page's text, each page read once."""
    return html.map(_strip, na_action="ignore")


def _id(kind: str, *names: Column) -> Column:
    """A urn:uuid from the digest of a name."""
    d = F.sha2(F.concat_ws("\t", F.lit(kind), *[F.coalesce(n, F.lit("")) for n in names]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 4), F.lit("-"), F.substring(d, 17, 4), F.lit("-"), F.substring(d, 21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a page table."""
    html = F.coalesce(column(pages, "html", "string"), F.lit(""))
    uri = column(pages, "url", "string")
    key = column(pages, "page_id", "bigint")
    date = F.coalesce(column(pages, "fetched", "string"), F.lit(DATE))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    return pages.select(
        key.alias("page_id"), F.lit("response").alias("record_type"), _id("response", key.cast("string"), uri).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), uri.alias("target_uri"), date.alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), _digest(html).alias("payload_digest"), F.concat(head, html).alias("block"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records."""
    split = F.locate("\r\n\r\n", F.col("block"))
    payload = F.when(split > 0, F.expr("substring(block, locate('\\r\\n\\r\\n', block) + 4)")).otherwise(F.col("block"))
    headers = F.when(split > 0, F.expr("substring(block, 1, locate('\\r\\n\\r\\n', block) - 1)")).otherwise(F.lit(""))
    rows = records.filter("record_type = 'response'").withColumns({"_payload": payload, "_headers": headers})
    rows = rows.withColumn("_text", plain_text(F.col("_payload")))
    name = (F.col("record_id"), F.coalesce("payload_digest", _digest(F.col("_payload"))))
    conversion = _id("conversion", *name)
    facts = F.concat(
        F.lit("conversion-id: "), conversion, F.lit("\r\nconversion-digest: "), _digest(F.col("_text")),
        F.lit("\r\npayload-digest: "), name[1], F.lit("\r\ncharacters: "), F.char_length("_text").cast("string"),
        F.lit("\r\nsource-headers: "), F.regexp_replace("_headers", "\r\n", "; "), F.lit("\r\n"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("t"), _id("metadata", *name).alias("i"), F.lit("application/warc-fields").alias("c"), facts.alias("b")),
        F.struct(F.lit("conversion").alias("t"), conversion.alias("i"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("_text").alias("b")),
    )
    return rows.withColumn("payload_digest", name[1]).select("*", F.explode(made).alias("d")).select(
        "page_id", F.col("d.t").alias("record_type"), F.col("d.i").alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", F.col("d.c").alias("content_type"), "payload_digest", F.col("d.b").alias("block"),
    )


def with_header(records: DataFrame) -> DataFrame:
    """Adds block_digest, content_length and header, the record's lines up to the blank one."""
    known = {"WARC-Type": F.col("record_type"), "WARC-Record-ID": F.col("record_id"), "WARC-Date": F.col("date"), "WARC-Target-URI": F.col("target_uri"), "WARC-Refers-To": F.col("refers_to"), "WARC-Payload-Digest": F.col("payload_digest"), "WARC-Block-Digest": F.col("block_digest"), "Content-Type": F.col("content_type"), "Content-Length": F.col("content_length").cast("string")}
    lines = [F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value) for name, value in known.items()]]
    sized = records.withColumns({"block_digest": _digest(F.col("block")), "content_length": F.octet_length("block").cast("bigint")})
    return sized.withColumn("header", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n")))


def serialise(records: DataFrame) -> DataFrame:
    """One gzip member a record, as WARC files concatenate them: (record_id, member)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = [gzip.compress(head.encode() + b"\r\n" + block.encode() + b"\r\n\r\n", mtime=0) for head, block in zip(batch["header"], batch["block"])]
            yield pd.DataFrame({"record_id": batch["record_id"], "member": members})

    rows = with_header(records).select("record_id", "header", "block")
    return rows.mapInPandas(run, "record_id string, member binary")


def parse(members: DataFrame) -> DataFrame:
    """Records of gzip members, the inverse of serialise()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for member in batch["member"]:
                head, _, rest = gzip.decompress(bytes(member)).partition(b"\r\n\r\n")
                f = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                body = rest[: int(f["Content-Length"])].decode()
                out.append((f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), f["WARC-Date"], f["Content-Type"], f.get("WARC-Payload-Digest"), f.get("WARC-Block-Digest"), body))
            yield pd.DataFrame(out, columns=["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "block"])

    return members.select("member").mapInPandas(run, "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, block string")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = with_header(derive(responses(table(spark, sf_dir, "pages"))))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "header", "block")


def _sql_id(kind: str, *names: str) -> str:
    d = "sha256(concat_ws(chr(9), '" + kind + "', " + ", ".join(f"coalesce({n}, '')" for n in names) + "))"
    parts = ", '-', ".join(f"substring({d}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat('<urn:uuid:', {parts}, '>')"


def _sql_text(html: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    literal = lambda x: quote(x) if "\n" not in x else "chr(10)"
    out = html
    for pattern, replacement in TEXT_RULES[:3]:
        out = f"regexp_replace({out}, {quote(pattern)}, {literal(replacement)}, 'g')"
    for name, value in ENTITIES.items():
        out = f"replace({out}, {quote(name)}, {quote(value)})"
    for pattern, replacement in TEXT_RULES[3:]:
        out = f"regexp_replace({out}, {quote(pattern.replace(chr(92) + 'n', chr(10)))}, {literal(replacement)}, 'g')"
    return out


ORACLE_SQL = {
    "op10_warc_derivatives": f"""
WITH r AS (
  SELECT page_id, url AS target_uri, {_sql_id("response", "CAST(page_id AS VARCHAR)", "url")} AS refers_to,
         concat('sha256:', sha256(coalesce(html, ''))) AS payload_digest, {_sql_text("coalesce(html, '')")} AS txt
  FROM pages),
c AS (SELECT *, {_sql_id("conversion", "refers_to", "payload_digest")} AS conversion_id,
             {_sql_id("metadata", "refers_to", "payload_digest")} AS metadata_id FROM r),
m AS (
  SELECT page_id, 'metadata' AS record_type, metadata_id AS record_id, refers_to, target_uri, 'application/warc-fields' AS content_type, payload_digest,
         concat('conversion-id: ', conversion_id, chr(13), chr(10), 'conversion-digest: sha256:', sha256(txt), chr(13), chr(10),
                'payload-digest: ', payload_digest, chr(13), chr(10), 'characters: ', length(txt), chr(13), chr(10),
                'source-headers: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8', chr(13), chr(10)) AS block
  FROM c
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, refers_to, target_uri, 'text/plain; charset=utf-8', payload_digest, txt FROM c)
SELECT page_id, record_type, record_id, refers_to, target_uri, '{DATE}' AS date, content_type, payload_digest,
       concat('sha256:', sha256(block)) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length,
       concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: {DATE}', 'WARC-Target-URI: ' || target_uri,
                 'WARC-Refers-To: ' || refers_to, 'WARC-Payload-Digest: ' || payload_digest, 'WARC-Block-Digest: sha256:' || sha256(block),
                 'Content-Type: ' || content_type, 'Content-Length: ' || strlen(block)) || chr(13) || chr(10) AS header, block
FROM m
"""
}

"""Periodic run detection by heavy/light lag counting.

A run is a stretch of words with smallest period q, at least LEAST words and EXPONENT
periods long, that no neighbour extends. A stretch of L words with period q holds L - q
consecutive matches (words q apart that are equal), so a lag can only have a run if it has
max(LEAST - q, (EXPONENT - 1) * q) matches in the whole text. These are counted for all lags
at once: a frequent word's by the autocorrelation of its 0/1 positions (FFT; the counts are
whole numbers below 2^53 and rounding gives them back), a rare word's as differences of
its positions. Only lags with enough matches get an island scan, by ascending lag; matches
that the runs found explain at multiples of their period are taken off first, so a text
that repeats one word does not scan every lag.

A text is one row, so the work is dealt over tasks by documents; for a text of n words
counting costs at most about n^1.5 steps and memory stays in proportion to n.

Edge cases: null, empty or blank text has no words: no runs, four nulls, digests of the
empty string; a null doc_id has no crc32, so its words stay as they are; rows that
repeat a doc_id are treated each by itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import column, table

LEAST, EXPONENT = 6, 4
#: A word is frequent when the square of its count is above this share of N log2(N), N the FFT's length.
HEAVY = 0.2
#: Probes of a block at first, then four times as many while blocks are left and a look at all matches costs more.
PROBES = 8


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to most, the number of i with ids[i] == ids[i + lag]; ids are
    numbered from 0."""
    n, counts = len(ids), np.zeros(most + 1, np.int64)
    size = 1 << (n + most).bit_length()
    often = np.bincount(ids)
    heavy = np.flatnonzero(often.astype(np.float64) ** 2 > HEAVY * size * math.log2(size))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            f = np.fft.rfft(ids == word, size)
            power += f.real**2 + f.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    end = np.repeat(np.cumsum(often), often)
    light = np.ones(len(often), bool)
    light[heavy] = False
    at, k = np.flatnonzero(light[ids[order]]), 1
    while True:
        at = at[at + k < end[at]]
        lag = order[at + k] - order[at]
        near = lag <= most
        at, lag = at[near], lag[near]  # later partners are farther still
        if not len(at):
            return counts
        found = np.bincount(lag)
        counts[: len(found)] += found
        k += 1


def _islands(ids: np.ndarray, q: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of the maximal stretches of need or more matches at lag q."""
    a, b = ids[:-q], ids[q:]
    # Among need matches in a row is a whole block that starts at a multiple of its length.
    block = (need + 1) // 2
    if len(a) > 4096 and block > PROBES:
        start, width = np.arange(0, len(a) - block + 1, block), PROBES
        while width < block and len(start) * width < len(a):
            here = start[:, None] + np.arange(width) * (block - 1) // (width - 1)
            start = start[(a[here] == b[here]).all(axis=1)]
            if not len(start):
                return start, start
            width *= 4
    breaks = np.concatenate([[-1], np.flatnonzero(a != b), [len(a)]])
    run = np.diff(breaks) - 1
    long = np.flatnonzero(run >= need)
    return breaks[long] + 1, run[long]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the sequence, by start, then period."""
    most = len(ids) // EXPONENT
    if len(ids) < LEAST or not most:
        return []
    counts, lags = lag_counts(ids, most), np.arange(most + 1)
    needs = np.maximum(LEAST - lags, (EXPONENT - 1) * lags)
    needs[0] = len(ids) + 1
    out: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(counts >= needs).tolist():
        if counts[q] < needs[q]:
            continue
        for start, matches in zip(*map(np.ndarray.tolist, _islands(ids, q, int(needs[q])))):
            length = matches + q
            # A stretch whose smallest period is a divisor of q came with that.
            if (start, length) in out:
                continue
            out[start, length] = q
            # At a multiple m of q the run explains length - m matches. It shares fewer than
            # q of them with each neighbour that has period m, so 2q stay counted.
            last = min(most, length - 2 * q - 1)
            if last >= 2 * q:
                many = lags[2 * q : last + 1 : q]
                counts[many] -= length - many - 2 * q
    return sorted((start, length, q) for (start, length), q in out.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's words: one text in ten goes on in a period from some word on."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
REPORT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _row(doc_id: int | None, text: str | None) -> tuple:
    words = repeated((text or "").encode("utf-8", "replace").split(), doc_id)
    runs = find_runs(numbered(words))
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = [w for w, stays in zip(words, collapsed(len(words), runs)) if stays] if runs else words
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
        out = pd.DataFrame([_row(i, t) for i, t in zip(ids, batch["text"])], columns=COLUMNS)
        yield out.astype({c: "Int64" for c in COLUMNS[:6]})


def report(docs: DataFrame) -> DataFrame:
    # Ids travel as text: a null would turn their batch into doubles.
    rows = docs.select(column(docs, "doc_id", "bigint").cast("string").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInPandas(_rows, REPORT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))

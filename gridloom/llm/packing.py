"""Packing documents into training sequences by minimum bin slack.

A task packs its documents in blocks of bounded size. Each document is tokenised
once and cut into full windows and a remainder. For the remainders only the count
of each length matters: a window starts with the longest one left, and a subset-sum
dynamic program over a bitset finds which other lengths, each at most as often as
it is left, come closest to the window's capacity. Walking the bitsets backwards
gives the counts of the lengths in the window, which is repeated while they last.
If no lengths fill a window, one more document is cut to fill it and its tail goes
back to the rest. Tokens left at a block's end make sequences of powers of two, which need
no padding.

No shuffle and no shared state: a sequence lies within one block of one task, its
id is the task's number and a counter, so a task that runs again packs alike.

Edge cases: null text is empty; every document has its end token, so an empty one
is one token long; repeated rows and equal doc_ids are packed one by one; a null
doc_id stays null; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import column, table, text_or_empty

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Tokens that a task packs at a time.
BLOCK_TOKENS = 4_000_000
#: Words whose ids a worker remembers.
CACHED_WORDS = 600_000
#: Longest text to go to the tokenizer at once, in new words.
NEW_WORDS = 2000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class _Seen(dict):
    """Ids by word, in two generations: words not met while a generation fills go."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.new = limit, {}, set()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            self.new.add(word)
            return b""
        self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def _byte_characters() -> dict[int, str]:
    """The vocabulary's character for each byte: itself if printable, else the next
    one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of whole texts, word by word: this vocabulary drops white space and never
    joins over it, so a text's ids are those of its words. A word of letters, or of
    letters and one mark, is one unit or two for the tokenizer and goes to its model
    at once; any other goes through the whole tokenizer."""

    MARKS = ".,;:!?"

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.seen = Tokenizer.from_file(path), _Seen(cached // 2)
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.marks = {m: self._unit(m) for m in self.MARKS}

    def _unit(self, text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.characters)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(text)])

    def learn(self, new: list[bytes]) -> None:
        others = []
        for word in new:
            text = word.decode()
            mark, letters = b"", text
            if text[-1] in self.MARKS:
                mark, letters = self.marks[text[-1]], text[:-1]
            if letters.isascii():
                simple, low = letters.isalpha(), letters.lower()
            else:
                low = unicodedata.normalize("NFC", letters)
                simple = low.isalpha() and "\u03a3" not in low
                low = low.lower()
                simple = simple and low.isalpha()
            if simple:
                self.seen[word] = self._unit(low) + mark
            else:
                others.append(word)
        for at in range(0, len(others), NEW_WORDS):
            part = others[at : at + NEW_WORDS]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.seen[word] = np.array(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        found = [list(map(self.seen.__getitem__, words)) for words in split]
        if self.seen.new:
            new, self.seen.new = self.seen.new, set()
            self.learn(list(new))
        out = []
        for words, ids in zip(split, found):
            at = -1
            for _ in range(ids.count(b"")):
                at = ids.index(b"", at + 1)
                ids[at] = self.seen[words[at]]
            out.append(b"".join(ids))
        self.seen.turn()
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fill(counts: dict[int, int], gap: int) -> list[tuple[int, int]]:
    """Lengths and how often each, at most counts, whose sum is nearest to gap from
    below. Bit s of reach tells whether some choice sums to s."""
    mask, full, reach = (1 << (gap + 1)) - 1, 1 << gap, 1
    layers: list[tuple[int, int]] = []
    for length in sorted((k for k, n in counts.items() if n and k <= gap), reverse=True):
        for _ in range(min(counts[length], gap // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            layers.append((length, reach))
            reach = grown
            if reach & full:
                break
        if reach & full:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(layers):
        if not before >> total & 1:
            used[length] += 1
            total -= length
    return list(used.items())


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int, tuple[int, int] | None]]:
    """Windows for remainders of these lengths: (lengths and their counts, how many
    such windows, (length to cut, piece) or None). Cut-off tails join the counts."""
    left, out = defaultdict(int, {k: n for k, n in counts.items() if n}), []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = defaultdict(int, best_fill(left, window - longest))
        left[longest] += 1
        used[longest] += 1
        times = min(left[k] // n for k, n in used.items())
        gap, cut = window - sum(k * n for k, n in used.items()), None
        if gap:
            longer = [k for k, n in left.items() if k > gap and n > used[k]]
            if longer:
                cut = (min(longer), gap)
                times = min(times, left[cut[0]] // (used[cut[0]] + 1))
            else:
                times = 1
        for k, n in used.items():
            left[k] -= n * times
        if cut:
            left[cut[0]] -= times
            left[cut[0] - gap] += times
        left = defaultdict(int, {k: n for k, n in left.items() if n})
        out.append(([(k, n) for k, n in used.items() if n], times, cut))
    return out


def pack_block(docs: list[tuple[int | None, bytes]], window: int = WINDOW) -> Iterator[tuple]:
    """docs: doc_id and ids. Yields (document's index, start, length, sequence, offset)."""
    pieces: dict[int, deque] = defaultdict(deque)
    sequence = 0
    for d, (_, ids) in enumerate(docs):
        n, start = len(ids) // 4, 0
        while n - start >= window:
            yield d, start, window, sequence, 0
            start, sequence = start + window, sequence + 1
        if n > start:
            pieces[n - start].append((d, start))
    for used, times, cut in plan({k: len(v) for k, v in pieces.items()}, window):
        for _ in range(times):
            parts = [(*pieces[k].popleft(), k) for k, n in used for _ in range(n)]
            if cut:
                d, start = pieces[cut[0]].popleft()
                parts.append((d, start, cut[1]))
                pieces[cut[0] - cut[1]].append((d, start + cut[1]))
            if sum(k for _, _, k in parts) == window:
                offset = 0
                for d, start, k in parts:
                    yield d, start, k, sequence, offset
                    offset += k
                sequence += 1
                continue
            # The block's last tokens: sequences of powers of two.
            room, offset = 0, 0
            total = sum(k for _, _, k in parts)
            for d, start, k in parts:
                while k:
                    if not room:
                        room, offset = 1 << (total.bit_length() - 1), 0
                        total -= room
                        sequence += 1
                    take = min(room, k)
                    yield d, start, take, sequence - 1, offset
                    start, k, room, offset = start + take, k - take, room - take, offset + take


def _packer(path: str, window: int, block_tokens: int):
    end = struct.pack("<I", END_ID)

    def rows(docs: list, first: int) -> tuple[pd.DataFrame, int]:
        out, last = [], first - 1
        for d, start, length, sequence, offset in pack_block(docs, window):
            doc_id, ids = docs[d]
            out.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, first + sequence, offset))
            last = max(last, first + sequence)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"}), last + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, docs, held = tokenizer(path), [], 0
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                for doc_id, ids in zip(part["doc_id"].tolist(), encoder.encode(part["text"].tolist())):
                    docs.append((None if pd.isna(doc_id) else int(doc_id), ids + end))
                    held += len(ids) // 4 + 1
                if held >= block_tokens:
                    out, sequence = rows(docs, sequence)
                    yield out
                    docs, held = [], 0
        if docs:
            yield rows(docs, sequence)[0]

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The pieces of all documents, as in SCHEMA."""
    rows = docs.select(column(docs, "doc_id", "bigint").cast("string").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInPandas(_packer(tokenizer_path, window, block_tokens), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())


def op2_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())

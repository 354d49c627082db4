"""Hidden Markov language model over words.

Emission alphabet: the commonest training words (at most TOP, each at least a part in
20 * TOP of all tokens, so no more than 20 * TOP words are ranked) are symbols of their own; every
other word belongs to one of BUCKETS symbols by its first and last letters and is
drawn within it by its count plus one. So P(word | state) = P(symbol | state) *
P(word | symbol), the tables of the states have a fixed size, and counts of all words
take part. Baum-Welch: tasks run scaled forward-backward passes over each whole training
text and send expected counts by symbol and state, which are summed by symbol; the
sums give the next model, until the likelihood gains less than TOLERANCE. Scores come from the exact scaled forward recursion over
each whole text.

Words meet their counts by batch: a task codes its texts in a batch's own word numbers
and lists each word of the batch once; the list is joined with the counts and goes back
to the batch. A word thus moves once a batch, not once a token.

Edge cases: a null text is empty and holds only its end token; a null doc_id is in the
training part; repeated rows count as often as they occur; without training tokens
every word is unknown and the model is the one-state start model; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, materialise, table, text_or_empty

TOP, BUCKETS, STATES, ITERATIONS = 16384, 8192, 8, 100
#: Training ends when the log likelihood gains less than this share, or at ITERATIONS.
TOLERANCE = 1e-3
SYMBOLS = TOP + BUCKETS
#: Tokens of a batch.
BATCH_TOKENS = 5_000_000
#: Tokens that a task of a training pass puts in order of length, two bytes each (a text counts
#: as TEXT more), and those that it passes at once, about 100 bytes each. Texts of like length share their steps.
SORTED, TEXT, CHUNK = 8 << 20, 100, 1 << 20
#: Texts of more than LONG tokens are passed in segments where that costs less. A token
#: in segments costs 1 more than side by side, a step of texts side by side STEP.
LONG, SEGMENT, STEP = 4096, 64, 40
#: Weight of the overall symbol frequencies in each state's emissions.
PRIOR = 50.0
END = b""

CODED = "batch bigint, doc_id bigint, train boolean, ids binary, word binary, wid int, c bigint"
SCORED = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, within double, symbols binary"


def _code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as numbers of their batch's words; then the words with training counts."""
    number, held = TaskContext.get().partitionId() << 32, 0
    # A word not met yet gets the next number.
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    counts = np.zeros(0, np.int64)

    def words() -> Iterator[pd.DataFrame]:
        names = list(index)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            wid = np.arange(at, at + len(part))
            yield pd.DataFrame({"batch": number, "doc_id": pd.array([None] * len(part), "Int64"), "train": None, "ids": None, "word": part, "wid": wid, "c": counts[wid]})

    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            coded = []
            for text in part["text"]:
                tokens = text.encode("utf-8", "replace").lower().split()
                tokens.append(END)
                coded.append(np.fromiter(map(index.__getitem__, tokens), np.int32, len(tokens)))
            counts = np.concatenate([counts, np.zeros(len(index) - len(counts), np.int64)])
            train = part["train"].to_numpy(bool)
            learned = [ids for ids, t in zip(coded, train) if t]
            if learned:
                counts += np.bincount(np.concatenate(learned), minlength=len(counts))
            held += sum(map(len, coded))
            ids = [x.tobytes() for x in coded]
            doc_id = [None if pd.isna(x) else int(x) for x in part["doc_id"]]
            yield pd.DataFrame({"batch": number, "doc_id": pd.array(doc_id, "Int64"), "train": train, "ids": ids, "word": None, "wid": pd.array([None] * len(part), "Int32"), "c": pd.array([None] * len(part), "Int64")})
            if held >= BATCH_TOKENS:
                yield from words()
                number, held, index, counts = number + 1, 0, defaultdict(count().__next__), np.zeros(0, np.int64)
    if index:
        yield from words()


def _bucket(word: Column) -> Column:
    """By the first two and last three bytes."""
    return F.pmod(F.crc32(F.concat(F.expr("substring(word, 1, 2)"), F.expr("substring(word, -3, 3)"))), F.lit(BUCKETS)).cast("int")


def _score_words(top: dict[bytes, int], bucket_mass: np.ndarray, total: int, vocabulary: int):
    """Per batch: texts in symbols, with the sums that do not depend on states."""
    unit = math.log10(total + vocabulary + 1)

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        wid = words["wid"].to_numpy()
        c, symbol = np.zeros(len(wid)), np.zeros(len(wid), np.int64)
        c[wid] = words["c"].to_numpy(np.float64)
        symbol[wid] = words["bucket"].to_numpy() + TOP
        within = np.log10(c + 1) - np.log10(bucket_mass[symbol - TOP])
        own = words[words["word"].notna()]
        for i, word in zip(own["wid"], own["word"]):
            symbol[i], within[i] = top[bytes(word)], 0.0
        base, known = np.log10(c + 1) - unit, c > 0
        out = []
        for doc_id, train, raw in zip(docs["doc_id"], docs["train"], docs["ids"]):
            ids = np.frombuffer(raw, np.int32)
            out.append((None if pd.isna(doc_id) else int(doc_id), bool(train), len(ids), int(known[ids].sum()), float(base[ids].sum()), float(within[ids].sum()), symbol[ids].astype(np.uint16).tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCORED.split(", ")]).astype({"doc_id": "Int64"})

    return run


class Model:
    """start, moves and emissions of the states; emissions by symbol."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit

    @staticmethod
    def first(prior: np.ndarray, states: int) -> "Model":
        noise = np.exp(np.random.default_rng(7).normal(0, 1, (len(prior), states)))
        emit = prior[:, None] * noise
        return Model(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit / emit.sum(axis=0))

    def expected(self, symbols: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of (symbol, state), moves and starts, and the log likelihood.
        symbols: texts one after another; fresh: true at the first token of each."""
        starts = np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, len(symbols)))
        # Steps side by side are as many as the longest text's tokens, so the few that are much longer go apart.
        ordered = np.append(-np.sort(-lengths), 0)
        cost = np.cumsum(ordered) - ordered + STEP * ordered
        limit = ordered[np.argmin(cost[: np.count_nonzero(lengths > LONG) + 1])]
        long = np.repeat(lengths > limit, lengths)
        parts = [run(symbols[keep], fresh[keep]) for run, keep in ((self._side_by_side, ~long), (self._in_segments, long)) if keep.any()]
        return tuple(sum(x) for x in zip(*parts))

    def _side_by_side(self, symbols: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """expected() by a step a token position over all texts that reach it. Tokens are
        laid out by position, longer texts first, so a step is one slice."""
        k, starts = len(self.start), np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, len(symbols)))
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        active = len(lengths) - np.cumsum(np.bincount(lengths))[:-1]
        top = np.concatenate([[0], np.cumsum(active)])
        at = top[np.arange(len(symbols)) - np.repeat(starts, lengths)] + np.repeat(rank, lengths)
        ordered = np.empty(len(symbols), np.int64)
        ordered[at] = symbols
        # Emissions relative to the symbol's best state stay well within single precision.
        best = self.emit.max(axis=1)
        emit = np.take((self.emit / best[:, None]).astype(np.float32), ordered, axis=0)
        moves, back = self.moves.astype(np.float32), np.ascontiguousarray(self.moves.T, dtype=np.float32)
        alpha, scale = np.empty_like(emit), np.empty(len(symbols), np.float32)
        # A product with ones puts a row's sum beside each of its states.
        now, ones = np.tile(self.start.astype(np.float32), (len(lengths), 1)), np.ones((k, k), np.float32)
        spans = list(zip(top.tolist(), active.tolist()))
        for first, n in spans:
            here, seen = alpha[first : first + n], emit[first : first + n]
            np.multiply(now[:n], seen, out=here)
            total = here @ ones
            np.maximum(total, 1e-30, out=total)
            here /= total
            seen /= total
            scale[first : first + n] = total[:, 0]
            np.matmul(here, moves, out=now[:n])
        # Emissions now hold the scale; a text's backward message is one until its last token.
        moved, beta = np.zeros((k, k)), np.ones((len(lengths), k), np.float32)
        for t in range(len(spans) - 1, -1, -1):
            first, n = spans[t]
            ahead = emit[first : first + n]
            ahead *= beta[:n]
            alpha[first : first + n] *= beta[:n]
            if t:
                before = spans[t - 1][0]
                moved += alpha[before : before + n].T @ ahead
                np.matmul(ahead, back, out=beta[:n])
        del emit
        counts = np.stack([np.bincount(ordered, weights=alpha[:, j], minlength=SYMBOLS) for j in range(k)], axis=1)
        likelihood = np.log(scale).sum(dtype=np.float64) + np.bincount(ordered, minlength=len(best)) @ np.log(best)
        return counts, moved * self.moves, alpha[: top[1]].sum(axis=0, dtype=np.float64), float(likelihood)

    def _in_segments(self, symbols: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """expected() of long texts: each is padded to whole segments and passes run over
        all segments at once. The product of a segment's steps carries the forward message
        into the next segment of its text and the backward message into the one before,
        so the counts are those of the whole text."""
        k, starts = len(self.start), np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, len(symbols)))
        parts = -(-lengths // SEGMENT)
        top = np.cumsum(parts) - parts
        rows = int(parts.sum())
        at = np.arange(len(symbols)) + np.repeat(top * SEGMENT - starts, lengths)
        # Padding emits with certainty, so it leaves the backward message as it is.
        pad = len(self.emit)
        grid = np.full(rows * SEGMENT, pad)
        grid[at] = symbols
        grid = grid.reshape(rows, SEGMENT).T
        emit, moves = np.vstack([self.emit, np.ones((1, k))]).astype(np.float32), self.moves.astype(np.float32)
        into, out = self._carried(grid, top, parts, emit, moves)
        alpha, scale = np.empty((SEGMENT, rows, k), np.float32), np.empty((SEGMENT, rows, 1), np.float32)
        now = into
        for t in range(SEGMENT):
            now = now * emit[grid[t]]
            scale[t] = np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
            alpha[t] = now / scale[t]
            now = alpha[t] @ moves
        last, moved = alpha[-1].copy(), np.zeros((k, k))
        beta = out / np.maximum((last * out).sum(axis=1, keepdims=True), 1e-30)
        for t in range(SEGMENT - 1, -1, -1):
            gamma = alpha[t] * beta
            ahead = emit[grid[t]] * beta / scale[t]
            if t:
                beta = ahead @ moves.T
            ahead[grid[t] == pad] = 0
            if t:
                moved += (alpha[t - 1].T @ ahead).astype(np.float64) * self.moves
            else:
                ahead[top] = 0
                moved += (last[:-1].T @ ahead[1:]).astype(np.float64) * self.moves
            alpha[t] = gamma
        flat = alpha.transpose(1, 0, 2).reshape(-1, k)[at]
        counts = np.stack([np.bincount(symbols, weights=flat[:, j], minlength=SYMBOLS) for j in range(k)], axis=1)
        likelihood = np.log(scale[:, :, 0].T.reshape(-1)[at], dtype=np.float64).sum()
        return counts, moved, flat[starts].sum(axis=0, dtype=np.float64), float(likelihood)

    def _carried(self, grid: np.ndarray, top: np.ndarray, parts: np.ndarray, emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per segment: the distribution of states before it, and the backward message
        at its end. top: the first segment of each text; parts: their number."""
        k, rows = len(self.start), grid.shape[1]
        into, out = np.tile(self.start.astype(np.float32), (rows, 1)), np.ones((rows, k), np.float32)
        long = np.repeat(parts > 1, parts)
        number = np.cumsum(long) - 1
        part = grid[:, long]
        steps = np.tile(np.eye(k, dtype=np.float32), (part.shape[1], 1, 1))
        for t in range(SEGMENT):
            steps *= emit[part[t]][:, None, :]
            steps = (steps.reshape(-1, k) @ moves).reshape(-1, k, k)
            steps /= np.maximum(steps.max(axis=(1, 2), keepdims=True), 1e-30)
        for j in range(1, int(parts.max())):
            row = top[parts > j] + j
            carried = np.einsum("rk,rkl->rl", into[row - 1], steps[number[row - 1]])
            into[row] = carried / np.maximum(carried.sum(axis=1, keepdims=True), 1e-30)
        first = np.ones((rows + 1, k), np.float32)
        for j in range(int(parts.max()) - 1, 0, -1):
            row = top[parts > j] + j
            follows = np.where((row - j + parts[parts > j] - 1 > row)[:, None], first[row + 1], np.float32(1))
            carried = np.einsum("rkl,rl->rk", steps[number[row]], follows)
            first[row] = carried / np.maximum(carried.max(axis=1, keepdims=True), 1e-30)
            out[row - 1] = first[row] @ moves.T
        return into, out

    def log10_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact scaled forward recursion, over all texts side by side."""
        order = np.argsort([-len(x) for x in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]) if texts else np.zeros(0, np.int64)
        at, out = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), np.zeros(len(texts))
        state, active = np.tile(self.start, (len(texts), 1)), len(texts)
        for t in range(int(lengths[0]) if len(texts) else 0):
            while lengths[active - 1] <= t:
                active -= 1
            now = state[:active] * self.emit[flat[at[:active] + t]]
            scale = now.sum(axis=1)
            out[:active] += np.log10(scale)
            state = (now / scale[:, None]) @ self.moves
        result = np.empty(len(texts))
        result[order] = out
        return result


def _expectation(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.start)
        counts, moved, starts, likelihood = np.zeros((SYMBOLS, k)), np.zeros((k, k)), np.zeros(k), 0.0
        held, size = [], 0

        def add(texts: list[np.ndarray]) -> None:
            nonlocal counts, moved, starts, likelihood
            fresh = np.zeros(sum(map(len, texts)), bool)
            fresh[np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]])] = True
            got = model.expected(np.concatenate(texts), fresh)
            counts, moved, starts, likelihood = counts + got[0], moved + got[1], starts + got[2], likelihood + got[3]

        def add_held() -> None:
            nonlocal held, size
            held.sort(key=len, reverse=True)
            ends = np.cumsum([len(x) for x in held])
            at = 0
            while at < len(held):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                add(held[at:end])
                at = end
            held, size = [], 0

        for batch in batches:
            for raw in batch["symbols"]:
                held.append(np.frombuffer(raw, np.uint16))
                size += len(held[-1]) + TEXT
                if size >= SORTED:
                    add_held()
        add_held()
        used = np.flatnonzero(counts.any(axis=1))
        values = np.concatenate([counts[used], moved, starts[None], np.full((1, k), likelihood)])
        symbol = np.concatenate([used, np.arange(SYMBOLS, SYMBOLS + k + 2)])
        yield pd.DataFrame({"symbol": symbol} | {f"s{j}": values[:, j] for j in range(k)})

    return run


def train(texts: DataFrame, prior: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the rows' symbols. The sums that reach the driver have one row
    a symbol, so their size is fixed."""
    model = Model.first(prior, states)
    names = [f"s{j}" for j in range(states)]
    schema = "symbol bigint, " + ", ".join(f"{c} double" for c in names)
    reached = None
    for _ in range(iterations):
        sums = texts.select("symbols").mapInPandas(_expectation(model), schema).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        if sums.empty:
            break
        counts = np.zeros((SYMBOLS + states + 2, states))
        counts[sums["symbol"].to_numpy()] = sums[names].to_numpy()
        emit = counts[:SYMBOLS] + PRIOR * prior[:, None]
        moves, start, likelihood = counts[SYMBOLS:-2] + 0.1, counts[-2] + 0.1, counts[-1, 0]
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        if reached is not None and likelihood - reached < TOLERANCE * abs(reached):
            break
        reached = likelihood
    return model


def score(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    held_out = F.coalesce(F.pmod(F.crc32(column(docs, "doc_id", "bigint").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select(column(docs, "doc_id", "bigint").cast("string").alias("doc_id"), text_or_empty(docs).alias("text"), (~held_out).alias("train"))
    coded = materialise(rows.mapInPandas(_code, CODED), "hmm-coded")
    words = coded.filter("word is not null").select("batch", "wid", "word", "c")
    counts = materialise(words.groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0"), "hmm-counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = [(bytes(r["word"]), r["c"]) for r in counts.filter(F.col("c") * (20 * TOP) >= F.lit(total)).orderBy(F.desc("c"), "word").limit(TOP).collect()]
    top = {word: i for i, (word, _) in enumerate(common)}
    last_word, last_c = common[-1] if common else (b"", 0)
    is_top = (F.col("c") > last_c) | ((F.col("c") == last_c) & (F.col("word") <= F.lit(bytearray(last_word)))) if common else F.lit(False)
    buckets = counts.filter(~is_top).groupBy(_bucket(F.col("word")).alias("b")).agg((F.sum("c") + F.count("*")).alias("m")).collect()
    mass = np.ones(BUCKETS)
    for r in buckets:
        mass[r["b"]] += r["m"]
    prior = np.concatenate([[c + 1.0 for _, c in common], np.full(TOP - len(common), 1e-3), mass])
    prior /= prior.sum()

    listed = words.select("batch", "wid", "word").join(counts, "word", "left").select(F.col("batch").alias("at"), "wid", F.coalesce("c", F.lit(0)).alias("c"), _bucket(F.col("word")).alias("bucket"), F.when(F.coalesce(is_top, F.lit(False)), F.col("word")).alias("word"))
    texts = coded.filter("ids is not null").select("batch", "doc_id", "train", "ids")
    scored = texts.groupBy("batch").cogroup(listed.groupBy("at")).applyInPandas(_score_words(top, mass, total, vocabulary), SCORED)
    scored = materialise(scored, "hmm-symbols")
    discard(coded, counts)
    model = train(scored.filter("train"), prior, states, iterations)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = model.log10_likelihood([np.frombuffer(x, np.uint16) for x in batch["symbols"]])
            yield batch.drop(columns=["symbols", "doc_id"]).assign(doc_id=batch["doc_id"].astype("Int64") if batch["doc_id"].dtype != object else batch["doc_id"], score=got + batch["within"])[["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]]

    out = scored.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(forward, "doc_id string, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

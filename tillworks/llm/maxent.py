"""Hashed maximum-entropy language model with a class-factored softmax.

A word's probability is ``P(class | history) * P(word | class)``. The class softmax is a
maximum-entropy model over hashed features of the history: the word before, the words two and
three before (skips), and the pair of the two words before. Within a class words follow their
smoothed counts, which come from all training documents. Training is by distributed gradient
updates: every task runs minibatch gradient steps over its documents from the shared weights,
and the tasks' weights are averaged by their tokens. Scoring works on sparse numpy batches.

A word is a 64-bit code: its hash, with the three lowest bits telling its ending. Classes are
frequency tiers times endings; the ``FREQUENT`` most frequent words are known to every task,
all others are looked up by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table

FREQUENT = 200_000  # words whose counts every task holds (24 bytes each)
TIERS = (100, 2_000, 20_000)  # ranks at which the tiers of frequent words end
ENDINGS = 8
CLASSES = 1 + (len(TIERS) + 2) * ENDINGS  # the end, the tiers, the tier of all other words
SIZES = (1 << 13, 1 << 12, 1 << 11, 1 << 12)  # buckets of: word before, two before, three before, pair before
BATCH = 8192  # tokens of one gradient step
ROUNDS, RATE = 2, 0.3
PARTS = 64  # pieces in which weights travel
CACHE = 300_000
SMOOTH = 0.1
END = np.uint64(8)  # code of the end; no word has it


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        code = (xxhash.xxh64_intdigest(word, 11) & ~7) | (zlib.crc32(word[-2:]) & 7)
        self[word] = code
        return code


_codes = _Codes()


def codes_of(text: str | None) -> np.ndarray:
    """Codes of the words of a whole text (ASCII letters lower-cased), then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


@dataclass
class Table:
    """Counts: of the frequent words (by code), of each class, and in all."""

    codes: np.ndarray
    counts: np.ndarray
    tiers: np.ndarray
    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table, and whether the code is there."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        return at, self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)

    def classes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, known = self.find(codes)
        tier = np.where(known, self.tiers[at] if len(self.codes) else 0, len(TIERS) + 1)
        found = 1 + tier * ENDINGS + (codes & np.uint64(7)).astype(np.int64)
        return np.where(codes == END, 0, found), at, known

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.words + 1)))

    def within(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class); the end is alone in its class."""
        own = np.log10((counts + SMOOTH) / (self.class_tokens[classes] + SMOOTH * (self.class_words[classes] + 1)))
        return np.where(classes == 0, 0.0, own)


def histories(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(features, tokens) rows of the weights: hashed words before each token; zero before a text's start."""
    n = len(codes)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    mix = codes * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(32)
    before = []
    for k in (1, 2, 3):
        b = np.zeros(n, np.uint64)
        b[k:] = mix[:-k]
        b[at < k] = 0
        before.append(b)
    pair = (before[0] * np.uint64(0xBF58476D1CE4E5B9)) ^ before[1]
    pair ^= pair >> np.uint64(29)
    rows, first = [], 0
    for h, size in zip((*before, pair), SIZES, strict=True):
        rows.append(first + ((h >> np.uint64(7)) % np.uint64(size)).astype(np.int64))
        first += size
    return np.stack(rows)


def _raised(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the weights (tokens, classes) less a bound that keeps ``exp`` in range, their ``exp``, and its sum over the classes, (tokens, 1)."""
    z = weights.take(rows[0], axis=0)
    held = np.empty_like(z)
    for r in rows[1:]:
        z += weights.take(r, axis=0, out=held, mode="clip")
    z += weights[-1]
    if z.size:
        top = z.max()
        z -= top if top - z.min() < 80 else z.max(1, keepdims=True)
    e = np.exp(z, out=held)
    return z, e, (e @ np.ones(e.shape[1], e.dtype))[:, None]


def class_logs(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log P(class | history), (tokens, classes)."""
    z, _, total = _raised(weights, rows)
    return z - np.log(total)


def own_logs(weights: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log P(class | history) of each token's own class."""
    z, _, total = _raised(weights, rows)
    return z[np.arange(len(classes)), classes] - np.log(total[:, 0])


def _sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, uses: np.ndarray, few: int = 8) -> np.ndarray:
    """The sum of the rows ``order[first : first + uses]`` of ``g`` for each group; groups of up to ``few`` rows are added row by row, all at once."""
    total = g.take(order[first], axis=0)
    for k in range(1, few):
        at = np.flatnonzero((uses > k) & (uses <= few))
        if not len(at):
            break
        total[at] += g.take(order[first[at] + k], axis=0)
    for at in np.flatnonzero(uses > few):
        held = g.take(order[first[at] : first[at] + uses[at]], axis=0)
        total[at] = np.ones(len(held), held.dtype) @ held
    return total


def step(weights: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """One minibatch gradient step in place; a row's step is its mean gradient, so frequent rows cannot overshoot."""
    _, g, total = _raised(weights, rows)
    g /= total
    g[np.arange(len(classes)), classes] -= 1
    for r in rows.astype(np.uint16) if len(weights) <= 1 << 16 else rows:
        order = np.argsort(r, kind="stable")
        own = r[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        uses = np.diff(np.append(first, len(own)))
        weights[own[first]] -= _sums(g, order, first, uses) * (rate / uses)[:, None].astype(np.float32)
    weights[-1] -= np.float32(rate) * g.mean(0)


def _gathered(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, codes, starts) of texts put together until they have ``most`` tokens."""
    ids, held, n = [], [], 0
    for f in frames:
        for i, text in zip(f.column("rid").to_pylist(), f.column("text"), strict=True):
            own = codes_of(text.as_py())
            ids.append(i)
            held.append(own)
            n += len(own)
            if n >= most:
                yield ids, np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
                ids, held, n = [], [], 0
    if held:
        yield ids, np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])


def counts(docs: DataFrame) -> DataFrame:
    """(code, n) of all words of the training texts, and of the end."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, _ in _gathered(frames, 2_000_000):
            code, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    return docs.select(F.lit(0).alias("rid"), "text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def tabulate(counted: DataFrame, frequent: int = FREQUENT) -> Table:
    """The driver's table: the ``frequent`` commonest words and the sums of every class."""
    top = counted.where(F.col("code") != int(END)).orderBy(F.col("n").desc(), "code").limit(frequent).toPandas()
    tier = np.searchsorted(TIERS, np.arange(len(top)), side="right")
    codes = top["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    # Words beyond the table: counted by ending.
    rest = counted.groupBy(F.col("code").bitwiseAND(7).alias("e"), (F.col("code") == int(END)).alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    last = 1 + (len(TIERS) + 1) * ENDINGS
    for r in rest:
        at = 0 if r["end"] else last + r["e"]
        tokens[at], words[at] = r["n"], r["v"]
    n = top["n"].to_numpy(np.int64)
    ending = (codes & np.uint64(7)).astype(np.int64)
    for of, add in ((tokens, n), (words, np.ones(len(n)))):
        of += np.bincount(1 + tier * ENDINGS + ending, add, CLASSES) - np.bincount(last + ending, add, CLASSES)
    return Table(codes[order], n[order], tier[order].astype(np.int64), int(tokens.sum()), int(words.sum()), tokens, words)


def train(docs: DataFrame, table: Table, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Weights (buckets + 1, classes). Each round sees the documents of its own hash part, so all are used once."""
    context = docs.sparkSession.sparkContext
    shape = (sum(SIZES) + 1, CLASSES)
    weights = np.zeros(shape, np.float32)
    known = context.broadcast(table)
    edges = np.linspace(0, shape[0], PARTS + 1).astype(int)
    for k in range(rounds):
        shared = context.broadcast(weights)

        def run(frames: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            own, seen = shared.value.copy(), 0
            for _, codes, starts in _gathered(frames, 8 * BATCH):
                classes = known.value.classes(codes)[0]
                rows = histories(codes, starts)
                for at in range(0, len(codes), BATCH):
                    step(own, rows[:, at : at + BATCH], classes[at : at + BATCH], rate / (k + 1))
                seen += len(codes)
            if seen:
                parts = [(own[a:b] - shared.value[a:b]).astype("<f4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array(parts, pa.binary())], names=["part", "n", "w"])

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(n * np.frombuffer(w, "<f4").astype(np.float64) for n, w in zip(frame["n"], frame["w"], strict=True)) / frame["n"].sum()
            return pd.DataFrame({"part": [frame["part"].iloc[0]], "w": [total.astype("<f4").tobytes()]})

        own = docs.where(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == k).select("rid", "text")
        moved = own.mapInArrow(run, "part int, n long, w binary").groupBy("part").applyInPandas(mean, "part int, w binary")
        for r in moved.collect():
            a, b = edges[r["part"]], edges[r["part"] + 1]
            weights[a:b] += np.frombuffer(r["w"], "<f4").reshape(b - a, CLASSES)
    return weights


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns where ``held_out`` is false.

    Scores are log10 probabilities of whole texts, the end included. Null and empty texts are the
    end alone. Every row comes back, repeated ones too; without training rows counts are zero and
    both scores follow the smoothing alone. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    own = docs.select("doc_id", held_out.alias("held_out"), "text", F.xxhash64("doc_id", "text").alias("rid"))
    learn = own.where("not held_out")
    counted = stage_table(counts(learn))
    table = tabulate(counted)
    weights = train(learn, table)
    known, model = context.broadcast(table), context.broadcast(weights)
    ln10 = np.log(10.0)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with code null: sums of one text; others: its words beyond the table."""
        t = known.value
        end = t.class_tokens[0]
        for ids, codes, starts in _gathered(frames, 4 * BATCH):
            classes, at, found = t.classes(codes)
            rows = histories(codes, starts)
            logs = np.empty(len(codes))
            for a in range(0, len(codes), BATCH):
                logs[a : a + BATCH] = own_logs(model.value, rows[:, a : a + BATCH], classes[a : a + BATCH]) / ln10
            n = np.where(found, t.counts[at], 0) if len(t.codes) else np.zeros(len(codes))
            ends = codes == END
            n = np.where(ends, end, n)
            sure = found | ends
            base = np.where(sure, t.base(n), 0.0)
            score = logs + np.where(sure, t.within(classes, n), 0.0)
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(codes), np.int64), (sure & (n > 0)).astype(np.int64), base, score)]
            yield _rows(ids, None, *sums)
            rest = np.flatnonzero(~sure)
            if len(rest):
                doc = np.searchsorted(starts, rest, side="right") - 1
                order = np.lexsort((codes[rest], doc))
                doc, code = doc[order], codes[rest][order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))
                times = np.diff(np.append(first, len(doc)))
                none = np.zeros(len(first))
                yield _rows([ids[d] for d in doc[first]], code[first].view(np.int64), times, none.astype(np.int64), none, none)

    # Identical rows have one key: their words are looked up once and their sums are the same.
    texts = own.select("rid", "text")
    parts = stage_table(texts.mapInArrow(run, "rid long, code long, n long, known long, base double, score double"))
    rest = parts.where("code is not null").select("rid", "code", "n").join(counted.withColumnRenamed("n", "c"), "code", "left")
    c = F.coalesce("c", F.lit(0))
    last = 1 + (len(TIERS) + 1) * ENDINGS
    tokens, words = (F.lit([float(x) for x in v[last:]]) for v in (table.class_tokens, table.class_words))
    ending = F.col("code").bitwiseAND(7).cast("int")
    within = F.log10((c + SMOOTH) / (F.get(tokens, ending) + SMOOTH * (F.get(words, ending) + 1)))
    base = F.log10((c + SMOOTH) / F.lit(table.tokens + SMOOTH * (table.words + 1)))
    looked = rest.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * base).alias("base2"), F.sum(F.col("n") * within).alias("score2"), F.count("*").alias("pairs")
    )
    docs_ = parts.where("code is null").select("rid", F.col("n").alias("n_tokens"), "known", "base", "score")
    copies = docs_.groupBy("rid").agg(F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("n_tokens", "known", "base", "score")])
    sums = copies.join(looked, "rid", "left")
    share = lambda x: F.coalesce(F.col(x) / F.col("copies"), F.lit(0))
    sums = sums.select(
        "rid", "n_tokens", (F.col("known") + share("known2")).cast("long").alias("n_known"), F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + share("base2")).alias("base_score"), (F.col("score") + share("score2")).alias("score"),
    )
    return own.select("doc_id", "held_out", "rid").join(sums, "rid").drop("rid")


def _rows(ids: list, codes: np.ndarray | None, n: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    code = pa.nulls(len(ids), pa.int64()) if codes is None else pa.array(codes)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), code, pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=["rid", "code", "n", "known", "base", "score"])

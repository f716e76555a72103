"""Ranked lexical search: short posting lists term at a time, long ones document at a time.

Documents are read once; of each only the terms that some item asks for are kept, numbered, with
their counts (a forward table in the shared folder). Corpus counts come from that table. The
documents of an Arrow batch then form one shard with its own posting lists. For an item, the
shard's short lists are summed into accumulators, which act as one more list whose largest value
in every block of documents is known. That list and the long ones go through the documents
together: blocks whose bounds cannot reach the item's least wanted score are skipped, the others
are scored whole, and the wanted score rises from window to window and from shard to shard.
Spark then ranks the best documents of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table

K = 20
ITEM_BYTES = 8 << 20  # item text on the driver at once, about
BLOCK = 64  # documents that share one bound of a list
WINDOW = 32  # blocks scored before the wanted score is looked at again
SHORT = 24  # a list is short if it holds at most one document in so many

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; none for null."""
    return (text or b"").translate(_KEPT).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): number of terms of each row's text, and its terms of ``vocabulary`` with their counts."""
    size = len(vocabulary)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            counts, parts = [], []
            for text in f.column("text").to_pylist():
                words = terms(text)
                counts.append(len(words))
                found = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                parts.append(np.unique(found[found >= 0], return_counts=True))
            cuts = np.cumsum([0, *[len(ids) for ids, _ in parts]]).astype(np.int32)
            ids, tfs = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [])))
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(counts, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    if size >= 1 << 31:
        raise ValueError("term numbers must fit 32 bits")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(work, "doc_id long, n long, ids array<int>, tfs array<int>")


class Best:
    """The ``k`` best documents of one item so far: largest score first, then smallest id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.none, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def wanted(self) -> int:
        """Documents with less than this score no longer matter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.r_[self.score, score], np.r_[self.none, none], np.r_[self.id, ids]
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[order], none[order], ids[order]


class Shard:
    """Posting lists of a batch of documents; places are documents by number within the batch."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, docs: int, size: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.worth = doc[order], worth[order]
        self.cuts = np.searchsorted(term[order], np.arange(size + 1))
        self.docs, self.blocks = docs, -(-docs // BLOCK)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounded(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block begins in list ``t``, and the block's largest worth."""
        if t not in self.bounds:
            first, last = self.cuts[t : t + 2]
            at = np.searchsorted(self.doc[first:last], np.arange(self.blocks + 1) * BLOCK) + first
            most = np.zeros(self.blocks, np.int64)
            some = at[1:] > at[:-1]
            most[some] = np.maximum.reduceat(self.worth, at[:-1][some])[: some.sum()] if some.any() else 0
            self.bounds[t] = at, most
        return self.bounds[t]

    def search(self, asked: list[tuple[int, int]], best: Best, none: np.ndarray, ids: np.ndarray) -> int:
        """Adds the shard's documents to ``best``; returns the number of blocks that were skipped."""
        lists = [(t, c) for t, c in asked if self.cuts[t + 1] > self.cuts[t]]
        if not lists:
            return self.blocks
        short = [(t, c) for t, c in lists if (self.cuts[t + 1] - self.cuts[t]) * SHORT <= self.docs]
        long = [(t, c) for t, c in lists if (self.cuts[t + 1] - self.cuts[t]) * SHORT > self.docs]
        # Term at a time: the sums of the short lists, seen from here on as one list with bounds.
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        for t, c in short:
            own = slice(self.cuts[t], self.cuts[t + 1])
            sums[self.doc[own]] += c * self.worth[own]
        bound = sums.reshape(-1, BLOCK).max(1)
        spread = [self.bounded(t) for t, _ in long]
        for (_, c), (_, most) in zip(long, spread, strict=True):
            bound = bound + c * most
        # The sums alone are scores reached already, so their k-th best is a first wanted score.
        wanted = best.wanted
        if np.count_nonzero(sums) >= best.k:
            wanted = max(wanted, int(np.partition(sums, -best.k)[-best.k]))
        skipped = 0
        for start in range(0, self.blocks, WINDOW):
            stop = min(start + WINDOW, self.blocks)
            live = bound[start:stop] >= wanted
            skipped += int((~live).sum())
            if not live.any():
                continue
            base = start * BLOCK
            score = sums[base : stop * BLOCK]  # each window is scored once, so the sums can be added to
            some = np.flatnonzero(live)
            if 2 * len(some) > stop - start:
                for (_, c), (at, _) in zip(long, spread, strict=True):
                    own = slice(at[start], at[stop])
                    score[self.doc[own] - base] += c * self.worth[own]
            else:
                for (_, c), (at, _) in zip(long, spread, strict=True):
                    for b in some + start:
                        own = slice(at[b], at[b + 1])
                        score[self.doc[own] - base] += c * self.worth[own]
            score = np.where(np.repeat(live, BLOCK), score, 0)
            found = np.flatnonzero(score >= wanted)
            if len(found):
                best.add(score[found], none[base + found], ids[base + found])
                wanted = max(wanted, best.wanted)
        return skipped


def _block(docs: DataFrame, items: list[Row], k: int) -> DataFrame:
    """(no, rank, doc_id, score) for the items of one block, which the driver holds."""
    asked = [Counter(terms(bytes(r.text) if r.text is not None else None)) for r in items]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for a in asked for t in a))}
    spark = docs.sparkSession
    out = "no long, doc_id long, score long"
    if not vocabulary:
        return spark.createDataFrame([], "no long, rank int, doc_id long, score long")
    table = stage_table(forward(docs, vocabulary))
    texts, words = table.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = dict(table.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # as many as the vocabulary, at most
    weight = np.zeros(len(vocabulary), np.int64)
    for t, own in df.items():
        weight[t] = math.floor(1000 * math.log((2 * texts + 2) / (2 * own + 1)))
    queries = [(r.no, [(vocabulary[t], c) for t, c in a.items() if weight[vocabulary[t]] > 0]) for r, a in zip(items, asked, strict=True)]
    queries = [(no, a) for no, a in queries if a]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for f in frames:
            n = f.column("n").to_numpy()
            ids, tfs = f.column("ids"), f.column("tfs")
            held = np.diff(ids.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), held)
            term, tf = ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            norm = 100 - 25 + (25 * n * texts) // words
            worth = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]))
            shard = Shard(doc, term, worth, len(n), len(weight))
            none = f.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            own = f.column("doc_id").fill_null(0).to_numpy()
            pad = shard.blocks * BLOCK - len(n)
            none, own = np.r_[none, np.ones(pad, bool)], np.r_[own, np.zeros(pad, np.int64)]
            for (_, a), b in zip(queries, best, strict=True):
                shard.search(a, b, none, own)
        for (no, _), b in zip(queries, best, strict=True):
            if len(b.score):
                arrays = [pa.array(np.full(len(b.score), no)), pa.array(b.id, mask=b.none), pa.array(b.score)]
                yield pa.RecordBatch.from_arrays(arrays, names=["no", "doc_id", "score"])

    found = table.where(F.size("ids") > 0).mapInArrow(work, out)
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("no", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Scores are the integer sums of the contract, over an item's terms with repeats; only those above
    0 are returned, equal ones by ascending doc_id, null ids last. Rows without terms (null or empty
    texts, punctuation) count nowhere and ask for nothing; rows that repeat an id count as
    documents, or are answered as items, of their own. Items are worked through in blocks of about
    ``item_bytes`` of text, each against all documents.
    """
    own = stage_table(items.select("item_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("no")))
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // item_bytes) or 1
    part = F.pmod(F.xxhash64("no"), F.lit(blocks))
    found = None
    for b in range(blocks):
        ranked = _block(docs, own.where(part == b).select("no", "text").collect(), k)
        found = ranked if found is None else found.unionByName(ranked)
    return found.join(own.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")

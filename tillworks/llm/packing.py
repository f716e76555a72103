"""Lexical retrieval packing: windows filled with a seed's BM25 neighbours.

Documents become token ids plus an end id. A document's full windows leave as sequences of
their own; what is left of it (under one window) is a piece. Pieces are dealt into shards by
their most telling terms, so that pieces that share rare terms meet; each shard is a BM25
inverted index with the statistics of the whole corpus. Seeds in shard order take their
best unused neighbours until the window is full; the last one taken is cut where the window
ends and its rest stays in the index. Only a shard's last window can stay short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.llm.tokens import ids_of, vocabulary

WINDOW = 2048
END = 1  # id put after every document
SHARD = 4096  # pieces of one inverted index
K1, B = 1.2, 0.75  # BM25 parameters
TOGETHER = 1024  # pieces whose distinct ids are found by one sort
TERMS = 24  # a seed's query: its terms of highest BM25 weight
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(window: int, path: str, pattern: str, size: int):
    """Rows of kind 0: full windows; 1: the rest, with its ids; 2: document frequencies of the task's rests."""
    schema = pa.schema(
        [("kind", pa.int8()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int32)
        for frame in frames:
            rows, rests = [], []
            for doc, text in zip(frame.column("doc_id"), frame.column("text"), strict=True):
                ids = np.append(ids_of(text.as_py(), path, pattern), np.uint16(END))
                n = len(ids)
                whole = n - n % window
                wide = ids[:whole].astype("<u4")
                for at in range(0, whole, window):
                    rows.append((0, doc.as_py(), at, window, n, zlib.crc32(wide[at : at + window].tobytes()), None))
                if n % window:
                    rest = ids[whole:]
                    rests.append(rest)
                    rows.append((1, doc.as_py(), whole, len(rest), n, None, rest.astype("<u2").tobytes()))
            for at in range(0, len(rests), TOGETHER):
                seen += np.bincount(distinct(rests[at : at + TOGETHER])[1], minlength=size).astype(np.int32)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if seen.any():
            one = (2, None, None, int(seen.max()), None, None, seen.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(one, schema, strict=True)], schema=schema)

    return run


def _frequencies(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' frequency tables: ``size`` numbers, whatever the corpus."""

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for f in frames:
            for b in f["ids"]:
                total += np.frombuffer(b, "<i4")
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    tables = parts.where("kind = 2").select("ids").mapInPandas(added, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = tables.toPandas()
    found = np.zeros(size, np.int64)
    found[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return found


def distinct(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, id, count) of the distinct ids of each piece, in that order, by one sort."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    key = np.concatenate(pieces).astype(np.uint32 if len(pieces) <= 1 << 16 else np.uint64)
    key |= np.repeat(np.arange(len(pieces), dtype=key.dtype) << 16, sizes)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    own = key[first]
    return (own >> 16).astype(np.int64), (own & 0xFFFF).astype(np.uint16), np.diff(np.append(first, len(key)))


class Index:
    """BM25 inverted index over the pieces of one shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        row, term, tf = distinct(pieces)
        norm = K1 * (1 - B + B * np.fromiter(map(len, pieces), np.int64, len(pieces)) / mean)[row]
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        ends = np.searchsorted(row, np.arange(len(pieces) + 1))
        self.own = [(term[a:b], weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        self.n = len(pieces)
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order].astype(np.int32), weight[order]
        self.at = np.append(0, np.cumsum(np.bincount(term, minlength=len(idf))))

    def query(self, i: int) -> np.ndarray:
        """The terms of piece ``i`` with the highest BM25 weight; terms without weight are left out."""
        terms, weights = self.own[i]
        best = np.argsort(-weights, kind="stable")[:TERMS]
        return terms[best[weights[best] > 0]]

    def neighbours(self, i: int) -> np.ndarray:
        """All pieces that share a query term with piece ``i``, best score first, ties in shard order."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query(i)]
        if not spans:
            return np.empty(0, np.int64)
        total = np.bincount(np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        found = np.flatnonzero(total > 0)
        return found[np.argsort(-total[found], kind="stable")]


def fill(pieces: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of one shard, each a list of (piece, first id in the piece, length).

    Every id of every piece is placed once. All windows but the last are full.
    """
    index = Index(pieces, idf, mean)
    used = np.zeros(len(pieces), np.int64)  # ids of each piece that are placed already
    size = np.array([len(p) for p in pieces], np.int64)
    head = 0

    def take(i: int, now: list, room: int) -> int:
        n = min(room, size[i] - used[i])
        now.append((int(i), int(used[i]), int(n)))
        used[i] += n
        return room - n

    while True:
        while head < len(pieces) and used[head] == size[head]:
            head += 1
        if head == len(pieces):
            return
        now: list[tuple[int, int, int]] = []
        seed = head
        room = take(seed, now, window)
        while room:
            near = index.neighbours(seed)
            near = near[(used[near] < size[near]) & (near != seed)]
            if not len(near):  # nothing left that shares a term: the next unused piece seeds the rest
                while head < len(pieces) and used[head] == size[head]:
                    head += 1
                if head == len(pieces):
                    break
                near = np.array([head])
                seed = head
            for i in near:
                room = take(i, now, room)
                if not room:
                    break
        yield now


def pack(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, tokenizer: tuple[str, str, int] | None = None) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document (its BPE ids, then the end id) lies in exactly one piece; a
    sequence's pieces follow each other from offset 0. A null or empty text is the end id alone.
    Repeated rows are packed as often as they come; a null doc_id stays null. Other columns are
    not read. ``tokenizer``: vocabulary path, pre-token pattern, number of ids.
    """
    path, pattern, size = tokenizer or vocabulary()
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = stage_table(own.mapInArrow(_encode(window, path, pattern, size), "kind byte, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"))
    df = _frequencies(parts, size)
    n, tokens = parts.where("kind = 1").agg(F.count("*"), F.sum("length")).first()
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    # A term of more than half the pieces says nothing about which belong together.
    idf[df * 2 > n] = 0
    mean = (tokens or 1) / max(n, 1)
    context = docs.sparkSession.sparkContext.broadcast(idf)  # one number for each id of the vocabulary

    @F.pandas_udf("t1 int, t2 int, salt long")
    def route(ids: pd.Series) -> pd.DataFrame:
        """The two most telling terms of a piece, and a salt that cuts groups with the same terms."""
        weigh, rows, blobs = context.value, [], ids.tolist()
        for at in range(0, len(blobs), TOGETHER):
            part = blobs[at : at + TOGETHER]
            row, term, tf = distinct([np.frombuffer(b, "<u2") for b in part])
            w = weigh[term] * tf / (tf + K1)
            ends = np.searchsorted(row, np.arange(len(part) + 1))
            for b, lo, hi in zip(part, ends, ends[1:], strict=False):
                best = lo + int(w[lo:hi].argmax())
                w[best] = -1.0
                second = lo + int(w[lo:hi].argmax())
                rows.append((int(term[best]), int(term[second]), zlib.crc32(b)))
        return pd.DataFrame(rows, columns=["t1", "t2", "salt"])

    rests = parts.where("kind = 1").select("doc_id", "start", "length", "doc_tokens", "ids", route("ids").alias("r"))
    # Staged, so that the sampling before the range partitioning does not route every piece a second time.
    rests = stage_table(rests.select("doc_id", "start", "length", "doc_tokens", "ids", "r.*"))
    shards = max(1, -(-n // shard))
    keys = ("t1", "t2", "salt", "doc_id")
    dealt = rests.repartitionByRange(shards, *keys).sortWithinPartitions(*keys, "start", "length")

    schema = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])

    def windows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, sequence = context.value, TaskContext.get().partitionId() << 32
        for block in _blocks(frames, shard):
            ids = [np.frombuffer(b, "<u2") for b in block["ids"]]
            rows = []
            for now in fill(ids, weigh, mean, window):
                offset = 0
                for i, at, length in now:
                    crc = zlib.crc32(ids[i][at : at + length].astype("<u4").tobytes())
                    rows.append((block["doc_id"][i], block["start"][i] + at, length, crc, block["doc_tokens"][i], 2 * sequence, offset))
                    offset += length
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    short = dealt.select("doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(windows, OUT)
    full = parts.where("kind = 0").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return full.union(short)


def _blocks(frames: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, list]]:
    """The rows of a partition, ``size`` at a time."""
    held: dict[str, list] = {}
    for f in frames:
        for at in range(0, f.num_rows, size):
            part = f.slice(at, size).to_pydict()
            for k, v in part.items():
                held.setdefault(k, []).extend(v)
            while len(held["ids"]) >= size:
                yield {k: v[:size] for k, v in held.items()}
                held = {k: v[size:] for k, v in held.items()}
    if held.get("ids"):
        yield held

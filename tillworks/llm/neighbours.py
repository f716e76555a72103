"""Nearest neighbours over shifted Hilbert curves.

Vectors are projected to a few dimensions several times, each time with another rotation and
shift, and every projection is ordered along a Hilbert curve. Spark range-partitions each
ordering into blocks of neighbouring keys. A query first meets the blocks around its own
place in each ordering; the windows merge, and exact inner products rerank them. That gives
each query a threshold, its 20th best so far. Isotropic vectors hold neighbours that no
projection keeps close, so an exact pass follows: every block carries a centre and a radius,
a query visits the blocks whose bound reaches its threshold, and nothing that could enter the
answer is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table

CURVES, AXES, LEVELS = 4, 4, 10  # orderings, projected dimensions, bits of each dimension
BLOCK = 2048  # vectors of neighbouring keys
QUERIES = 4096  # queries of a team, about
AT_ONCE = 512  # queries multiplied with a block at once
K = 20


def hilbert(points: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Hilbert keys of integer ``points`` (n, axes), each under ``2 ** levels``, by the transpose method."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (levels - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(levels - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def turn(curve: int, width: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal projection and shift of one ordering; the same for every run."""
    rng = np.random.default_rng(1000 + curve)
    return np.linalg.qr(rng.standard_normal((width, min(axes, width))))[0], rng.random(min(axes, width))


def keys(unit: np.ndarray, curve: int, axes: int = AXES, levels: int = LEVELS) -> np.ndarray:
    """Keys of unit vectors: projected coordinates lie in [-1, 1], shifted by up to one cell of the coarsest grid."""
    basis, shift = turn(curve, unit.shape[1], axes)
    cells = ((unit @ basis + 1 + shift) / 3 * (1 << levels)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << levels) - 1), levels)


def _clean(frames: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, asks, v): vectors that take part, as float64 bytes."""
    for f in frames:
        rows = []
        for i, v in zip(f.column("vec_id").to_pylist(), f.column("embedding").to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            a = np.array(v, np.float64)
            if np.isfinite(a).all() and a.any():
                rows.append((i, i % every == 0, len(a), a.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["vec_id", "asks", "width", "v"])


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query row the ``k`` best (row, id, score), ties to the smaller id; a query's own id is left out."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    if scores.shape[1] > k:  # all that reach the k-th value, then a stable cut
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.nonzero(scores > -np.inf)
    value = scores[row, col]
    rank = np.lexsort((ids[col], -value, row))
    row, col, value = row[rank], col[rank], value[rank]
    first = np.searchsorted(row, np.arange(len(own)))
    keep = (np.arange(len(row)) - first[row] < k) & (value > -np.inf)
    return row[keep], ids[col[keep]], value[keep]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of the components."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j : j + 1] * x[:, j][None, :]
    return out


def _series(first: int, last: int):
    """The numbers from ``first`` to ``last``, none if ``last`` is smaller."""
    return F.sequence(F.lit(first), F.lit(last)) if first <= last else F.lit(None).cast("array<int>")


def blocks(vectors: DataFrame, curves: int, block: int) -> DataFrame:
    """(curve, part, vec_id, asks, width, v): each ordering cut into blocks of neighbouring keys."""

    @F.pandas_udf("array<long>")
    def places(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        lengths = v.str.len().to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            a = _matrix(v.iloc[at].tolist())
            a = a / np.abs(a).max(1)[:, None]
            a /= np.linalg.norm(a, axis=1)[:, None]
            for i, own in zip(at, np.stack([keys(a, c) for c in range(curves)], 1), strict=True):
                out[i] = own
        return out

    every = vectors.withColumn("keys", places("v"))
    ordered = every.select("*", F.posexplode("keys").alias("curve", "key")).drop("keys")
    n = max(1, vectors.count() // block)
    dealt = ordered.repartitionByRange(n * curves, "curve", "width", "key", "vec_id")
    return dealt.withColumn("part", F.spark_partition_id())


def nearest(rows: DataFrame, every: int = 20, k: int = K, curves: int = CURVES, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest vectors (largest inner product) of each row whose vec_id is divisible by ``every``.

    ``rows``: (vec_id, embedding). Returns query_id, rank, vec_id, score. Null ids, and vectors
    that are null, empty, zero or hold null or non-finite components take no part. Rows of equal
    id are not candidates of each other; equal rows are otherwise candidates of their own.
    Vectors of another width than the query's are not compared. Ties go to the smaller vec_id.
    """
    own = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    vectors = stage_table(own.mapInArrow(lambda f: _clean(f, every), "vec_id long, asks boolean, width long, v binary"))
    placed = stage_table(blocks(vectors, curves, block))
    found = "query_id long, vec_id long, score double"

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, group in f.groupby(["curve", "part", "width"], sort=False):
                q = group[group["asks"]]
                if len(q):
                    ids = q["vec_id"].to_numpy()
                    row, col, value = _best(_products(_matrix(q["v"].tolist()), _matrix(group["v"].tolist())), group["vec_id"].to_numpy(), ids, k)
                    yield pd.DataFrame({"query_id": ids[row], "vec_id": col, "score": value})

    # Window pass: the vectors next to the query along each curve.
    near = stage_table(placed.select("curve", "part", "width", "asks", "vec_id", "v").mapInPandas(windows, found).distinct())
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    floor = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = vectors.where("asks").dropDuplicates(["vec_id", "v"]).join(floor, "vec_id", "left")
    groups = vectors.where("asks").count() // QUERIES + 1
    asked = asked.withColumn("team", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    # One curve's blocks hold every vector once; each team of queries meets each block in a group of its own, of bounded size.
    held = placed.where("curve = 0").select("part", "width", "vec_id", "v")
    ends = held.agg(F.min("part"), F.max("part")).first()
    lowest, highest = (0, -1) if ends[0] is None else ends
    teams = asked.select("team", "width", "vec_id", "floor", "v", F.explode(_series(lowest, highest)).alias("part"))
    others = held.withColumn("team", F.explode(_series(0, groups - 1)))

    def meet(asking: pa.Table, block: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(asking) or not len(block):
            return schema.empty_table()
        x, ids = _matrix(block.column("v").to_pylist()), block.column("vec_id").to_numpy()
        centre = x.mean(0)
        radius = np.sqrt(((x - centre) ** 2).sum(1).max())
        longest = np.sqrt((x**2).sum(1).max())
        out = []
        for at in range(0, len(asking), AT_ONCE):
            own = asking.slice(at, AT_ONCE)
            q, own_ids = _matrix(own.column("v").to_pylist()), own.column("vec_id").to_numpy()
            least = np.array([-np.inf if t is None else t for t in own.column("floor").to_pylist()])
            size = np.sqrt((q**2).sum(1))
            slack = 1e-12 * x.shape[1] * size * longest  # beyond any rounding of the products below
            todo = np.flatnonzero(q @ centre + size * radius + slack >= least)
            if not len(todo):
                continue
            q, own_ids, least, slack = q[todo], own_ids[todo], least[todo], slack[todo]
            rough = q @ x.T
            if len(ids) > k + 1:  # a query's own id may be among the first
                least = np.maximum(least, np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)])
            row, col = np.nonzero((rough >= (least - slack)[:, None]) & (ids[None, :] != own_ids[:, None]))
            score = np.zeros(len(row))
            for j in range(x.shape[1]):  # the stated measure, as in the window pass
                score += q[row, j] * x[col, j]
            rank = np.lexsort((ids[col], -score, row))
            row, col, score = row[rank], col[rank], score[rank]
            keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
            out.append(pa.Table.from_arrays([pa.array(own_ids[row[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    exact = teams.groupBy("part", "team", "width").cogroup(others.groupBy("part", "team", "width")).applyInArrow(meet, found)
    ranked = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of segments. If two fingerprints differ in at most
``tau`` bits, some segment starts a chain in which every prefix of ``l`` segments differs in
at most ``l * tau / segments`` bits. The first two links of the chain are turned into
equality keys (with five segments and tau 4: the first segment equal, the second equal but
for one masked bit), so only fingerprints that begin such a chain ever meet; the later links
are checked before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.llm.graph import components

BITS = 64
PORTION = 256  # texts whose shingles a task holds at once
ARROW_ROWS = 1024  # rows that a task and its Python worker hand each other at once where rows are whole texts or shingle sets
BLOCK = 8192  # fingerprints of one key that meet in one cell; larger groups are cut into pairs of blocks
WIDE = 64  # shingle sets of one cell that meet as rows; more are compared by their outlines inside tasks
MEET = 2048  # sets of one cell that a task compares; larger cells are cut into pairs of blocks
FIRST = 8  # partners of a set that a cell proposes before the others
SMALL = 1_000_000  # rows of a table of keys or ids up to which it may be broadcast (20 bytes each)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Arrow batches of ``rows`` for the actions run inside; both sides of a task hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hashes_of(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle of the ASCII-lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint_of(text: str | None, width: int) -> int:
    """The signed 64-bit SimHash; zero for a text without words."""
    h = hashes_of(text, width)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0]) if len(h) else 0


def fingerprint(text: Column, width: int = 4) -> Column:
    """Column of fingerprints; whole texts, Arrow batches."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return of(text)


def ring(tau: int, segments: int) -> tuple[list[int], list[list[int]]]:
    """Bit masks of the segments, and for each start the key masks of the first two chain links."""
    edges = np.linspace(0, BITS, segments + 1).round().astype(int)
    bits = [range(edges[i], edges[i + 1]) for i in range(segments)]
    masks = [sum(1 << b for b in own) for own in bits]
    one, two = tau // segments, 2 * tau // segments
    keys = []
    for s in range(segments):
        own, then = bits[s], bits[(s + 1) % segments]
        whole = masks[s] | masks[(s + 1) % segments]
        drops = {
            sum(1 << b for b in (*first, *second))
            for first in combinations(own, one)
            for second in combinations(then if one == 0 else [*own, *then], two - one)
        }
        keys.append(sorted(whole & ~d for d in drops))
    return masks, keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, masks: np.ndarray, quotas: list[int], tau: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among ``fps``: each found node is compared with those not yet found."""
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            diff = fps[left] ^ fps[x]
            near = np.ones(len(left), bool)
            total = np.zeros(len(left), np.int64)
            for mask, quota in zip(masks, quotas, strict=True):
                total += np.bitwise_count(diff & mask)
                near &= total <= quota
            near &= total <= tau
            for y in left[near]:
                yield int(fps[x]), int(fps[y])
            queue.extend(left[near])
            left = left[~near]


def _linked(fp: np.ndarray, bounds: np.ndarray, tau: int, most: int = 64) -> np.ndarray:
    """Which of the sorted groups hold a link at all: all distances within groups of up to ``most``; larger ones count as linked."""
    sizes = np.diff(bounds)
    group = np.repeat(np.arange(len(sizes)), sizes)
    found = sizes > most
    fp = fp.view(np.uint64)
    for d in range(1, min(most, int(sizes.max(initial=1)))):
        at = np.flatnonzero(group[d:] == group[:-d])
        if not len(at):
            break
        found[group[at[np.bitwise_count(fp[at] ^ fp[at + d]) <= tau]]] = True
    return found


def links(prints: DataFrame, tau: int = 4, segments: int = 5, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of ``prints.fp`` within ``tau`` bits.

    ``prints`` holds distinct fingerprints. A key with more than ``block`` of them is cut into
    blocks and each pair of blocks becomes a cell of its own, so no task holds more than two
    blocks of one key and no link is lost. A cell yields a spanning forest, never all pairs.
    """
    masks, keys = ring(tau, segments)
    tags = [(s, k, m) for s, own in enumerate(keys) for k, m in enumerate(own)]
    start_of, mask_of = np.array([t[0] for t in tags]), np.array([t[2] for t in tags], np.uint64)
    exact = [masks[s] | masks[(s + 1) % segments] for s in range(segments)]
    quotas = [(i + 1) * tau // segments for i in range(segments)]

    def keyed(df: DataFrame, starts: bool, *also: str) -> DataFrame:
        many = [(s, m) for s, m in enumerate(exact)] if starts else [(i, t[2]) for i, t in enumerate(tags)]
        of = F.array(*[F.struct(F.lit(i).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("val")) for i, m in many])
        return df.select("fp", *also, F.explode(of).alias("k")).select("fp", *also, "k.tag", "k.val")

    # A masked key unites a few exact cells; if it is large, so is one of them.
    parts = 2 ** max((exact[t[0]] & ~t[2]).bit_count() for t in tags)
    cells = keyed(prints, True).groupBy("tag", "val").count().where(F.col("count") > block // parts)
    cells = cells.select(F.col("tag").alias("start"), F.col("val").alias("fp"), "count")
    wide = keyed(cells.select("fp", "start", "count"), False, "start", "count")
    of_start = F.array(*[F.lit(int(s)) for s in start_of])
    wide = wide.where(F.element_at(of_start, F.col("tag") + 1) == F.col("start")).groupBy("tag", "val").agg(F.sum("count").alias("n"))
    large = stage_table(wide.select("tag", "val", F.ceil((F.col("n") + block) / block).cast("int").alias("blocks")))
    known = large.count()

    rows = keyed(prints, False)
    if known:
        rows = rows.join(F.broadcast(large) if known <= SMALL else large, ["tag", "val"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.least(own, c).cast("long") * F.col("blocks") + F.greatest(own, c)
        )
        rows = rows.select("tag", "val", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("cell"))
    else:
        rows = rows.select("tag", "val", "fp", F.lit(-1).cast("long").alias("cell"))

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in _closed(batches):
            kept = batch if kept is None else [np.concatenate(x) for x in zip(kept, batch, strict=True)]
            tag, val, cell, fp, last = *kept[:4], kept[4][-1]
            fresh = np.concatenate([[True], (tag[1:] != tag[:-1]) | (val[1:] != val[:-1]) | (cell[1:] != cell[:-1])])
            starts = np.flatnonzero(fresh)
            bounds = np.append(starts, len(tag))
            upto = len(starts) if last else len(starts) - 1
            out = []
            linked = _linked(fp, bounds, tau)
            for g in np.flatnonzero(np.diff(bounds[: upto + 1]) > 1):
                own = fp[bounds[g] : bounds[g + 1]].view(np.uint64)
                t = tag[bounds[g]]
                # Members that agree in the masked bits too meet under the first mask of their start already.
                if t and start_of[t - 1] == start_of[t]:
                    free = np.uint64(exact[start_of[t]]) & ~mask_of[t]
                    if not ((own ^ own[0]) & free).any():
                        continue
                if not linked[g]:
                    continue
                turned = np.array([masks[(start_of[t] + i) % segments] for i in range(segments)], np.uint64)
                out.extend(_forest(own, turned, quotas, tau))
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
            kept = [x[bounds[upto] :] for x in kept] if upto < len(starts) else None

    dealt = rows.repartition("tag", "val", "cell").sortWithinPartitions("tag", "val", "cell")
    return dealt.mapInArrow(meet, "a long, b long")


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each non-empty batch as arrays, and an array that is true in the last batch."""
    held = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield [*held, np.zeros(len(held[0]), bool)]
            held = [b.column(n).to_numpy() for n in ("tag", "val", "cell", "fp")]
    if held is not None:
        yield [*held, np.ones(len(held[0]), bool)]


def near_duplicates(docs: DataFrame, tau: int = 4, segments: int = 5, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and the smallest doc_id reachable over links of at most ``tau`` bits.

    One row for each row of ``docs`` (repeated rows too). A null or empty text, or one without
    words, has fingerprint zero and links like any other. A null doc_id never becomes a
    component id unless its whole component is null. Other columns of ``docs`` are not read.
    """
    prints = stage_table(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")))
    nodes = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(nodes.select("fp"), tau, segments))
    placed = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    owners = placed.join(least, "component").select("fp", "component_id")
    return prints.join(owners, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


LIKE = (4, 5)  # resemblance of a near-duplicate pair: at least 4/5
OUTLINE = 16  # long numbers of a set's outline
HOT = 64  # a shingle of more documents than about this goes to the end of the order
HOT_MOST = 1_000_000  # most such shingles, the commonest first; the pairs found do not depend on the choice
ORDER_SHARE = 16  # one text of so many is read to tell them


def shingles_of(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending as signed numbers."""
    return np.unique(hashes_of(text, width).view(np.int64))


def _needed(n: str) -> str:
    """How many first shingles of ``n`` to look up: in one order for all documents, alike sets share one of these."""
    return f"({n} - ({LIKE[0]} * {n} + {LIKE[1] - 1}) div {LIKE[1]} + 1)"


def _alike(shared: Column, n: Column, m: Column) -> Column:
    """Whether ``shared`` of ``n`` and ``m`` distinct shingles make a resemblance of ``LIKE``, in whole numbers."""
    return sum(LIKE) * shared >= LIKE[0] * (n + m)


def _portions(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The shingle sets of (text) batches, ``PORTION`` texts at a time."""
    for part in (f.slice(at, PORTION) for f in frames for at in range(0, f.num_rows, PORTION)):
        yield [shingles_of(t, width) for t in part.column("text").to_pylist()]


def name_of(shingles: np.ndarray) -> int:
    """The node that stands for all texts with these shingles."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), 42))


def _set_batches(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, n, shingles) of (text) batches."""
    for found in _portions(frames, width):
        cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(found), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(map(name_of, found)), pa.int64()), pa.array(list(map(len, found)), pa.int64()), lists], names=["node", "n", "shingles"])


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) of each text."""
    return texts.select("text").mapInArrow(lambda frames: _set_batches(frames, width), "node long, n long, shingles array<long>")


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles of many texts, ascending. They set the order of shingles and nothing else: the pairs found are the same for any order.

    So one text of ``ORDER_SHARE`` is enough to tell them.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _portions(frames, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0).select("text")
    with small_batches(texts.sparkSession):
        often = stage_table(some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") > HOT // ORDER_SHARE))
    return np.sort(_commonest(often, HOT_MOST))


def _cells(texts: DataFrame, width: int) -> DataFrame:
    """(h, node, n, i): the first shingles of each set and their places, where another set has ``h`` among its first.

    Common shingles go to the end of the order, so that a common line brings documents together
    only when little else is in them. Shingles are hashed in the task that reads the text; only
    the first ones leave it.
    """
    names, schema = ("h", "node", "n", "i"), "h long, node long, n long, i long"
    held = texts.sparkSession.sparkContext.broadcast(_common(texts, width))

    def first(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = held.value
        for found in _portions(frames, width):
            parts = []
            for own in found:
                n, node = len(own), name_of(own)
                if not n:
                    continue
                needed = n - (LIKE[0] * n + LIKE[1] - 1) // LIKE[1] + 1
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
                    own = np.concatenate([own[~last], own[last]])
                parts.append((own[:needed], np.full(needed, node), np.full(needed, n), np.arange(needed)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=list(names))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(c).to_numpy() for c in names]
            own = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            upto = int(np.searchsorted(own[0], own[0][-1]))  # the last shingle may go on in the next batch
            yield from repeated([c[:upto] for c in own])
            rest = [c[upto:] for c in own]
        if rest is not None:
            yield from repeated(rest)

    def repeated(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(own[0]):
            return
        fresh = np.append(True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]))  # a repeated row counts once
        own = [c[fresh] for c in own]
        same = own[0][1:] == own[0][:-1]
        if same.any():
            met = np.append(same, False) | np.append(False, same)
            yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in own], names=list(names))

    rows = texts.select("text").mapInArrow(first, schema)
    with small_batches(texts.sparkSession):
        return stage_table(rows.repartition("h").sortWithinPartitions("h", "node").mapInArrow(shared, schema))


def _commonest(counts: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` shingles of ``counts`` (h, count): whole powers of two of the count, the largest ones first.

    Only the number of shingles of each power and the chosen ones reach the driver.
    """
    power = F.floor(F.log2("count")).cast("int")
    total, least = 0, None
    for p, n in sorted(counts.groupBy(power.alias("p")).agg(F.count("*")).collect(), reverse=True):
        if total + n > most:
            break
        total, least = total + n, p
    chosen = counts.where(power >= least) if least is not None else counts.limit(0)
    return chosen.select("h").toArrow().column("h").to_numpy()


def _possible(a: str, b: str) -> Column:
    """Whether two rows of one cell can be alike: if it is their first common shingle, only those after it can be shared too."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.i"), F.col(f"{b}.n") - F.col(f"{b}.i"))
    return _alike(rest, F.col(f"{a}.n"), F.col(f"{b}.n"))


def _enough(shared: str = "shared", n: str = "n", m: str = "m") -> Column:
    """Whether sets of ``n`` and ``m`` shingles that have ``shared`` of their first ones in common can be alike.

    Alike sets share at least ``least`` shingles, so of either set's first ones at most ``n - least``
    are not shared. The set whose first ones end earlier in the order meets all its shared ones
    among the other's first.
    """
    least = f"(({LIKE[0]} * ({n} + {m}) + {sum(LIKE) - 1}) div {sum(LIKE)})"
    return F.expr(f"{shared} >= least({_needed(n)} - {n}, {_needed(m)} - {m}) + {least}")


def _met(rows: DataFrame) -> DataFrame:
    """(a, b) of pairs (p, q) met in cells, each cell they share being one row, that their first shingles let be alike."""
    found = rows.groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(
        F.count("*").alias("shared"), F.max(_possible("p", "q")).alias("possible"), F.max("p.n").alias("n"), F.max("q.n").alias("m")
    )
    return found.where(F.col("possible") & _enough()).select("a", "b")


def _few(df: DataFrame) -> DataFrame:
    """A table of ids, broadcast while it is small, so that the other side keeps its place."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _outlines(rows: DataFrame, width: int | None = None) -> DataFrame:
    """(node, n, bits): which of 64 * ``OUTLINE`` bits the shingles of a set hash to, as ``OUTLINE`` long numbers.

    ``rows`` are sets (node, n, shingles); with ``width`` they are texts, whose sets do not leave the worker that makes them.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, PORTION) for whole in batches for at in range(0, whole.num_rows, PORTION)):
            lists = b.column("shingles")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            on = np.zeros((b.num_rows, 64 * OUTLINE), bool)
            on[np.repeat(np.arange(b.num_rows), sizes), lists.flatten().to_numpy() & (64 * OUTLINE - 1)] = True
            bits = pa.array(np.packbits(on, axis=1).view(np.int64).ravel())
            cuts = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * OUTLINE)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.ListArray.from_arrays(cuts, bits)], names=["node", "n", "bits"])

    own, run = (rows.select("node", "n", "shingles"), draw) if width is None else (rows.select("text"), lambda frames: draw(_set_batches(frames, width)))
    with small_batches(rows.sparkSession):
        return stage_table(own.mapInArrow(run, "node long, n long, bits array<long>"))


def _most_shared(n: str, m: str, x: str, y: str) -> Column:
    """The most shingles two sets can share: each bit that only one set has on is a shingle that the other has not."""
    only = lambda one, two: sum(F.bit_count(F.col(one)[i].bitwiseAND(F.bitwise_not(F.col(two)[i]))) for i in range(OUTLINE))
    return F.least(F.col(n) - only(x, y), F.col(m) - only(y, x))


def _confirmed(pairs: DataFrame, sets_of: Callable[..., DataFrame]) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets are alike, by the sets themselves.

    ``sets_of`` gives the sets (node, n, shingles) of a table of nodes, or what :func:`_outlines` makes
    of their texts. Outlines of 128 bytes go first: pairs that cannot share enough leave before any set is sent.
    """

    def of(pairs: DataFrame, make: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        return sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), make)

    drawn = of(pairs, _outlines)
    met = pairs.join(drawn.toDF("a", "n", "x"), "a").join(drawn.toDF("b", "m", "y"), "b")
    left = stage_table(met.where(_alike(_most_shared("n", "m", "x", "y"), F.col("n"), F.col("m"))).select("a", "b"))
    with small_batches(pairs.sparkSession):
        own = stage_table(of(left, _sets))
    met = left.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b")
    return stage_table(met.where(_alike(F.size(F.array_intersect("x", "y")), F.col("n"), F.col("m"))).select("a", "b"))


def _wide(rows: DataFrame, drawn: DataFrame, ranks: slice) -> DataFrame:
    """Pairs (a, b) of different components in the cells ``rows`` (h, node, c) whose outlines (node, n, bits) let be alike.

    Every pair is looked at inside a task. Each set ranks the sets after it that pass by how much
    they can share; the pairs of the given ``ranks`` leave the task. Ranks do not depend on the
    components, so slices that make up the whole lose no pair. A cell of more than ``MEET`` sets
    is cut into blocks, and each pair of blocks becomes a cell of its own.
    """
    blocks = rows.groupBy("h").agg(F.ceil(F.count("*") / MEET).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))
    dealt = rows.join(blocks, "h").select("h", "node", "c", own.alias("own"), F.explode(cells).alias("cell")).join(drawn, "node")
    dealt = dealt.select("h", "cell.x", "cell.y", "own", "node", "c", "n", "bits").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(h, x, y, own, node, c, n, bits) -> Iterator[pa.RecordBatch]:
        on = np.bitwise_count(bits).sum(1).astype(np.int64)
        for i in range(len(node) - 1):
            both = np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1).astype(np.int64)
            shared = np.minimum(n[i] - on[i], n[i + 1 :] - on[i + 1 :]) + both
            near = sum(LIKE) * shared >= LIKE[0] * (n[i] + n[i + 1 :])
            if x[0] != y[0]:
                near &= own[i + 1 :] != own[i]
            at = np.flatnonzero(near)
            at = at[np.argsort(-shared[at], kind="stable")][ranks] + i + 1
            other = node[at[c[at] != c[i]]]
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, node[i])), pa.array(np.maximum(other, node[i]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy() for k in ("h", "x", "y", "own", "node", "c", "n")]
            now.append(b.column("bits").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, OUTLINE))
            kept = now if kept is None else [np.concatenate(k) for k in zip(kept, now, strict=True)]
            starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in kept[:3]], axis=0)))
            for p, q in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):  # the last cell may go on in the next batch
                yield from compare(*[k[p:q] for k in kept])
            kept = [k[starts[-1] :] for k in kept]
        if kept is not None:
            yield from compare(*kept)

    return dealt.mapInArrow(run, "a long, b long")


def _ringed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that span the links of their fingerprints, see :func:`links`."""
    owners = stage_table(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    found = links(owners.select("fp")).join(owners.toDF("a", "x"), "a").join(owners.toDF("b", "y"), "b")
    same = nodes.join(owners, "fp").where("node <> first")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same.select(F.col("first").alias("a"), F.col("node").alias("b")))


def alike(nodes: DataFrame, texts: DataFrame, sets_of: Callable[..., DataFrame], width: int) -> DataFrame:
    """(node, component) of the ``nodes`` (node, fp) that a resemblance of ``LIKE`` connects; nodes without a partner are not returned.

    The fingerprints' links, found by the pigeonring, are looked at first and confirmed by the
    shingle sets. Fingerprints of pairs near the bound may differ in more bits; an exact pass
    finds what is left between the groups: alike sets have some of their first shingles in
    common (prefix filter, ``texts`` holds one text for each node), each candidate is confirmed
    too. There each cell's sets meet its least one before all that are not yet in one component
    meet each other: as rows in cells of up to ``WIDE`` sets, by their outlines inside tasks in
    larger ones, see :func:`_wide`. No pair is missed and none is taken on trust.
    """
    cells = _cells(texts, width)
    row = F.struct("node", "n", "i")
    centre = cells.groupBy("h").agg(F.min(row).alias("p"))
    star = cells.select("h", row.alias("q")).join(centre, "h").where(F.col("p.node") < F.col("q.node"))
    tried = stage_table(_ringed(nodes).union(_met(star)).distinct())
    linked = _confirmed(tried, sets_of)
    placed = cells.join(components(linked), "node", "left").select("h", "node", "n", "i", F.coalesce("component", "node").alias("c"))
    split = placed.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("h")
    open_ = stage_table(placed.join(split, "h", "left_semi"))
    # A pair that shares a cell of many sets is found there; all cells that other pairs share are small, so what they share is counted in full.
    many = open_.groupBy("h").count().where(F.col("count") > WIDE).select("h")
    large = stage_table(open_.join(many, "h", "left_semi").select("h", "node", "c"))
    own = F.struct("node", "n", "i", "c")
    few = open_.join(many, "h", "left_anti")
    met = few.select("h", own.alias("p")).join(few.select("h", own.alias("q")), "h")
    met = _met(met.where((F.col("p.node") < F.col("q.node")) & (F.col("p.c") != F.col("q.c"))))
    if large.isEmpty():
        met = stage_table(met.join(tried, ["a", "b"], "left_anti"))
        return components(linked.union(_confirmed(met, sets_of)))
    # The likeliest partners first: they connect most of a large group, and what they connect needs no other pair.
    drawn = sets_of(large.select("node").distinct(), _outlines)
    met = stage_table(met.union(_wide(large, drawn, slice(0, FIRST))).distinct().join(tried, ["a", "b"], "left_anti"))
    linked = linked.union(_confirmed(met, sets_of))
    joined = components(linked)
    placed = large.drop("c").join(joined, "node", "left").select("h", "node", F.coalesce("component", "node").alias("c"))
    split = placed.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("h")
    rest = stage_table(_wide(placed.join(split, "h", "left_semi"), drawn, slice(FIRST, None)).distinct().join(tried.union(met), ["a", "b"], "left_anti"))
    return joined if rest.isEmpty() else components(linked.union(_confirmed(rest, sets_of)))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: that of least doc_id.

    Documents are linked when the exact Jaccard resemblance of their distinct ``width``-word shingles
    is at least ``LIKE``, see :func:`alike`; groups are what links connect. Texts without words
    (null and empty too) are copies of each other. Rows without a doc_id stay unless one with an id is in their group; rows
    that repeat a doc_id and its text become one.
    """

    def prints_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (f.slice(at, PORTION) for f in frames for at in range(0, f.num_rows, PORTION)):
            texts = part.column("text").to_pylist()
            found = [shingles_of(t, width) for t in texts]
            columns = [[name_of(s) for s in found], [len(s) for s in found], [fingerprint_of(t, 4) for t in texts]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "th", "node", "n", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    with small_batches(docs.sparkSession):
        rows = stage_table(keyed.mapInArrow(prints_of, f"doc_id {kind}, th long, node long, n long, fp long"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min(F.struct("doc_id", "th")).alias("one"))
    nodes = stage_table(nodes.select("node", "least", "n", "fp", F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th")))
    is_one = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("th") == F.col("one_th"))
    # One text stands for all with the same set.
    copies = rows.join(nodes.select("node", "one_id", "one_th"), "node").where(~is_one)
    copies = stage_table(copies.select(F.col("doc_id").alias("one_id"), F.col("th").alias("one_th")).distinct())
    texts = keyed.join(_few(copies), is_one, "left_anti").select("text")

    def sets_of(ids: DataFrame, make: Callable[[DataFrame, int], DataFrame] = _sets) -> DataFrame:
        wanted = stage_table(nodes.join(ids, "node", "left_semi").select("one_id", "one_th"))
        return make(keyed.join(_few(wanted), is_one, "left_semi"), width)

    placed = nodes.join(alike(nodes.where("n > 0").select("node", "fp"), texts, sets_of, width), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    owners = placed.join(placed.groupBy("component").agg(F.min("least").alias("keep")), "component").select("node", "keep")
    gone = rows.join(owners, "node").where("keep is not null and not (doc_id <=> keep)").select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th")).distinct()
    again = rows.where("doc_id is not null").groupBy("doc_id", "th").count().where("count > 1")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), own)
    left = left.join(_few(stage_table(gone)), F.col("id").eqNullSafe(F.col("gone")) & (F.col("th") == F.col("gone_th")), "left_anti")
    if not again.isEmpty():
        left = left.where("id is not null").dropDuplicates(["id", "th"]).union(left.where("id is null"))
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])

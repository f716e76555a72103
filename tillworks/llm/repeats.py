"""Repeated byte strings by suffix sorting over a content-defined difference cover.

The classic algorithm sorts the suffixes at a fixed cover of positions (two residues of
three), names them, recurses on the names, and merges the remaining suffixes through
(bytes before the next sampled position, name there). Residues do not line up between
documents, so every byte of the corpus would have to be sorted; here the cover is chosen by
content instead: position ``x(p)`` is the first least hash of an 8-byte gram in
the :func:`window` grams from ``p``. Equal strings have their sampled positions at the same
places, and every string of ``width`` bytes holds one, which is all the merge step needs.

1. *Sampled prefixes*: the ``width - window + 1`` bytes from each sampled position are named
   by a hash; a name that occurs once ends all strings over it (they cannot repeat).
2. *Triples and names of names*: names of consecutive sampled positions are joined with
   their distances, three at a time, then three of those names, and once more; equal joined
   names cover equal text, so strings inside are repeated. One member stands for each name
   from there on.
3. *Merge of the remaining suffixes*: starts between sampled positions that step 2 left open,
   and the members that stand for a name, meet by (bytes before, name, bytes after) in slots
   of ``SLOT`` starts and adjacent equal prefixes of ``width`` bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table

WIDTH = 400
WINDOW = 192  # starts that one sampled position can serve; half the width for shorter strings
GRAM = 8
SLOT = 16  # starts compared together in the merge
CHUNK = 1 << 20  # starts of one document handled at a time
HOT = 4_096  # positions of one name that one task takes
SMALL = 1_000_000  # rows named by a key of 8 bytes up to which the keys are broadcast


def window(width: int) -> int:
    return min(WINDOW, width // 2)


def cover(data: bytes, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(first start, sampled position of each start), a chunk of starts at a time."""
    total, most = len(data) - width + 1, window(width)
    steps = [1 << k for k in range(most.bit_length() - 1)]
    for at in range(0, max(0, total), CHUNK):
        n = min(CHUNK, total - at)
        raw = np.frombuffer(data, np.uint8, min(len(data) - at, n + most + GRAM), at)
        m = n + most - 1
        h = np.zeros(m, np.uint64)
        for k in range(GRAM):
            h |= raw[k : k + m].astype(np.uint64) << np.uint64(8 * k)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        where = np.arange(m)
        # Minima of 2, 4, ... places, then of the window; the earlier place wins a tie.
        for step in (s for s in (*steps, most - (1 << len(steps))) if s):
            right = h[step:] < h[:-step]
            where = np.where(right, where[step:], where[:-step])
            h = np.where(right, h[step:], h[:-step])
        yield at, where[:n] + at


def owners(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions in order, and the first and last start that each serves."""
    parts = [x for _, x in cover(data, width)]
    x = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if not len(x):
        return x, x, x
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[first], first, np.append(first[1:], len(x)) - 1


def _key(doc: Column, text: Column) -> Column:
    """Names a row by its content; identical rows share it and are told apart by their number."""
    return F.xxhash64(doc, text)


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _sampled(width: int, core: int):
    schema = pa.schema([("rid", pa.int64()), ("x", pa.int64()), ("core", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for f in frames:
            for rid, text in zip(f.column("rid").to_numpy(), f.column("text"), strict=True):
                data = _bytes(text)
                x = owners(data, width)[0]
                if len(x):
                    names = np.fromiter((digest(data[a : a + core], 7) for a in x.tolist()), np.uint64, len(x)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), rid)), pa.array(x), pa.array(names)], schema=schema)

    return lambda frames: _merged(run(frames), schema)


def _merged(frames: Iterator[pa.RecordBatch], schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Few larger batches instead of many small ones."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += f.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()


def _proven(sampled: DataFrame, width: int, core: int) -> tuple[DataFrame, DataFrame]:
    """From repeated sampled prefixes: starts proven to repeat, and the starts that stand for each name.

    Both are (rid, lo, hi), ranges of starts. ``sampled``: (rid, x, core, copies).
    """
    order = Window.partitionBy("rid").orderBy("x")

    def triple(df: DataFrame, name: str, end: str, step: int) -> DataFrame:
        """Joins each name with those ``step`` and ``2 * step`` positions on, where the text between is covered."""
        ahead = [(F.lead(name, k * step).over(order), F.lead("x", k * step).over(order), F.lead(end, k * step).over(order)) for k in (1, 2)]
        df = df.select("*", *[c.alias(f"{n}{k}") for k, own in enumerate(ahead, 1) for n, c in zip(("n", "x", "e"), own, strict=True)])
        one = (F.col("x1") <= F.col(end)) & F.col("n1").isNotNull()
        two = one & (F.col("x2") <= F.col("e1")) & F.col("n2").isNotNull()
        joined = F.xxhash64(
            F.lit(step), name, F.when(one, F.col("n1")), F.when(one, F.col("x1") - F.col("x")), F.when(two, F.col("n2")), F.when(two, F.col("x2") - F.col("x"))
        )
        reach = F.when(two, F.col("e2")).when(one, F.col("e1")).otherwise(F.col(end))
        return df.withColumns({f"{name}_": joined, f"{end}_": reach}).drop("n1", "x1", "e1", "n2", "x2", "e2")

    df = sampled.withColumn("end", F.col("x") + core)
    df = triple(triple(triple(df, "core", "end", 1), "core_", "end_", 1), "core__", "end__", 2)
    levels = F.array(*[F.struct(F.col(f"core{u}").alias("name"), F.col(f"end{u}").alias("end")) for u in ("__", "___")])
    rows = df.select("rid", "x", "copies", F.explode(levels).alias("l")).select("rid", "x", "copies", "l.name", (F.col("l.end") - width).alias("hi")).where("hi >= x").distinct()
    rows = stage_table(rows)
    names = rows.groupBy("name", (F.col("hi") - F.col("x")).alias("room")).agg(F.sum("copies").alias("n"), F.min(F.struct("rid", "x")).alias("first")).where("n > 1")
    names = stage_table(names)
    held = rows.withColumn("room", F.col("hi") - F.col("x")).join(names.select("name", "room"), ["name", "room"], "left_semi").select("rid", F.col("x").alias("lo"), "hi")
    stand = names.select("first.rid", F.col("first.x").alias("lo"), (F.col("first.x") + F.col("room")).alias("hi"))
    return held, stand


def _ranges(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias(name))


def _mask(n: int, ranges: list[dict] | None) -> np.ndarray:
    """True where one of the ranges of starts covers."""
    if not ranges:
        return np.zeros(n, bool)
    lo, hi = (np.array([r[k] for r in ranges]) for k in ("lo", "hi"))
    edges = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(hi + 1, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edges)[:n] > 0


def _slots(width: int):
    """Rows for the merge: (key, rid, base, around, open, need) for slots of starts at one sampled position.

    A slot holds the starts ``x - l`` with ``l`` in one aligned run of ``SLOT`` values. ``key`` names
    the text that all of them share, ``around`` holds the ``SLOT - 1`` bytes before and after it
    (zeros where the document ends). Bit t of ``open``: start ``base - t`` is compared; of ``need``:
    it is not known to repeat.
    """
    names = [("key", pa.int64()), ("rid", pa.int64()), ("base", pa.int64()), ("around", pa.binary()), ("open", pa.int32()), ("need", pa.int32())]
    schema, side = pa.schema(names), SLOT - 1

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        rows: list[tuple] = []
        for f in frames:
            for row in (r for at in range(0, f.num_rows, 64) for r in f.slice(at, 64).to_pylist()):
                if len(rows) >= 20_000:
                    yield packed(rows)
                    rows = []
                data = (row["text"] or "").encode("utf-8", "surrogatepass")
                x, lo, hi = owners(data, width)
                n = len(data) - width + 1
                proven, stand = _mask(n, row["proven"]), _mask(n, row["stand"])
                known = np.isin(x, np.array(row["sampled"], np.int64))
                wanted = np.concatenate([[0], np.cumsum(~proven | stand)])
                todo = known & (wanted[hi + 1] > wanted[lo])
                for a, p, q in zip(x[todo].tolist(), lo[todo].tolist(), hi[todo].tolist(), strict=True):
                    for slot in range((a - q) // SLOT, (a - p) // SLOT + 1):
                        base = a - slot * SLOT
                        near, far = max(slot * SLOT, a - q), min(slot * SLOT + side, a - p)
                        if wanted[a - near + 1] == wanted[a - far]:
                            continue
                        bits = need = 0
                        for start in range(a - far, a - near + 1):
                            if not proven[start]:
                                need |= 1 << (base - start)
                            if not proven[start] or stand[start]:
                                bits |= 1 << (base - start)
                        end = base - side + width
                        around = data[max(0, base - side) : base].rjust(side, b"\0") + data[end : end + side].ljust(side, b"\0")
                        key = digest(data[base:end], slot)
                        rows.append((key - (1 << 64) if key >> 63 else key, row["rid"], base, around, bits, need))
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _twins(key: np.ndarray, around: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Bits of the open starts whose whole string occurs in another row: same key, same bytes before and after."""
    side, base = SLOT - 1, np.uint64(0x9E3779B97F4A7C15)
    found = np.zeros(len(key), np.int32)
    before, after = [key.view(np.uint64) * base], [np.zeros(len(key), np.uint64)]
    with np.errstate(over="ignore"):
        for k in range(side):
            before.append((before[-1] ^ around[:, side - 1 - k].astype(np.uint64)) * base + np.uint64(k + 1))
            after.append((after[-1] ^ (around[:, side + k].astype(np.uint64) + np.uint64(1))) * base)
        for t in range(SLOT):
            at = np.flatnonzero(opened >> t & 1)
            if len(at) < 2:
                continue
            name = before[t][at] ^ (after[side - t][at] * np.uint64(0xBF58476D1CE4E5B9))
            name ^= name >> np.uint64(31)
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            twin = np.append(same, False) | np.append(False, same)
            found[at[order[twin]]] |= 1 << t
    return found


def _merge(slots: DataFrame) -> DataFrame:
    """Starts (rid, lo, hi) whose whole string occurs at another start too.

    Slots meet by key in one shuffle; within a key adjacent equal prefixes are repeats. A task
    holds the rows of the keys at hand only, 40 bytes each. Starts that stand for a proven name
    are compared but not returned.
    """
    schema = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for f in frames:
            if not f.num_rows:
                continue
            own = [f.column(n).to_numpy() for n in ("key", "rid", "base", "open", "need")]
            own.append(np.frombuffer(b"".join(f.column("around").to_pylist()), np.uint8).reshape(f.num_rows, -1))
            held = own if held is None else [np.concatenate(c) for c in zip(held, own, strict=True)]
            upto = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            if upto:
                yield from compared([c[:upto] for c in held])
                held = [c[upto:] for c in held]
        if held is not None:
            yield from compared(held)

    def compared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        same = rows[0][1:] == rows[0][:-1]
        met = np.append(same, False) | np.append(False, same)
        key, rid, base, opened, need, around = (c[met] for c in rows)
        twins = _twins(key, around, opened) & need
        row, bit = np.nonzero(twins[:, None] >> np.arange(SLOT)[None, :] & 1)
        if len(row):
            start = pa.array(base[row] - bit)
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), start, start], schema=schema)

    return slots.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rid long, lo long, hi long")


def spans_of(n_bytes: int, width: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs [from, to) of a text of ``n_bytes``, given the ranges of its repeated starts."""
    if n_bytes < width or not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    begin, end = lo[order], np.maximum.accumulate(hi[order]) + width
    first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    last = np.append(first[1:], len(begin)) - 1
    return list(zip(begin[first].tolist(), end[last].tolist(), strict=True))


def _cut(text: pa.Array, repeats: pa.Array, width: int) -> Iterator[tuple[bytes | None, list[tuple[int, int]]]]:
    """Each text's bytes with its removed runs."""
    at = repeats.offsets.to_numpy()
    lo, hi = (repeats.values.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
    for i, t in enumerate(text):
        data = None if t.as_py() is None else _bytes(t)
        yield data, spans_of(len(data or b""), width, lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]])


def _of(keyed: DataFrame, named: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``keyed`` whose rid is in ``named``, or (``left_anti``) is not; few keys are broadcast, so that other texts stay where they are."""
    ids = named.select("rid").distinct()
    return keyed.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "rid", how)


def _with_repeats(keyed: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``keyed`` with the column ``repeats`` of :func:`repeated_starts`, null without any; texts without repeats are not moved."""
    found = stage_table(repeated_starts(docs, width))
    some = _of(keyed, found).join(found, "rid")
    return some.union(_of(keyed, found, "left_anti").withColumn("repeats", F.lit(None).cast(found.schema["repeats"].dataType)))


def _suspects(sampled: DataFrame, often: DataFrame) -> DataFrame:
    """(rid, x, core, copies) of the positions of ``sampled`` whose name is in ``often`` (core, n).

    A name of over ``HOT`` positions is dealt to many tasks, by row.
    """
    shares = F.ceil(F.col("n") / HOT).cast("int")
    hot = often.where(F.col("n") > HOT).select("core", shares.alias("shares"))
    hot = F.broadcast(hot) if hot.count() <= SMALL else hot
    dealt = sampled.join(hot, "core", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    names = often.select("core", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    return dealt.join(names, ["core", "share"], "left_semi").groupBy("rid", "x", "core", "share").agg(F.count("*").alias("copies")).drop("share")


def repeated_starts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, repeats): for each row of ``docs`` (doc_id, text) with repeats, by its key, the ranges of its repeated starts.

    Identical rows have one key and come once; all starts of a row that occurs again are repeats.
    """
    core = width - window(width) + 1
    if core < GRAM:
        raise ValueError(f"width must be at least {2 * GRAM - 2}")
    keyed = docs.select(_key(F.col("doc_id"), F.col("text")).alias("rid"), "text").where(F.octet_length("text") >= width)
    sampled = stage_table(keyed.mapInArrow(_sampled(width, core), "rid long, x long, core long"))
    often = stage_table(sampled.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    suspects = stage_table(_suspects(sampled, often))
    held, stand = _proven(suspects, width, core)
    held, stand = stage_table(held), stage_table(stand)
    lists = suspects.groupBy("rid").agg(F.collect_set("x").alias("sampled"))
    lists = lists.join(_ranges(held, "proven"), "rid", "left").join(_ranges(stand, "stand"), "rid", "left")
    texts = stage_table(_of(keyed, suspects).join(lists, "rid").groupBy("rid").agg(*[F.first(c).alias(c) for c in ("text", "sampled", "proven", "stand")], F.count("*").alias("rows")))
    # A repeated row goes to the merge once and does not meet its own copy there.
    again = texts.where("rows > 1").select("rid", F.lit(0).cast("long").alias("lo"), (F.octet_length("text") - width).cast("long").alias("hi"))
    slots = texts.drop("rows").mapInArrow(_slots(width), "key long, rid long, base long, around binary, open int, need int")
    found = _merge(slots).union(held).union(again)
    return _ranges(found, "repeats")


def removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` rows as (doc_id, text, repeats): repeated starts of each whole text.

    All rows come back, repeated ones too; null text is empty. Texts under ``width`` bytes
    have no repeats. Matches never cross rows.
    """
    keyed = docs.select("doc_id", "text", _key(F.col("doc_id"), F.col("text")).alias("rid"))
    return _with_repeats(keyed, docs, width).select("doc_id", "text", "repeats")


def without_repeats(docs: DataFrame, width: int = WIDTH, words: int | None = None) -> DataFrame:
    """``docs`` with every repeated byte cut out of ``text``; all rows and all columns stay.

    With ``words``, a run of repeated bytes under ``WIDTH`` stays unless it holds more than so many words.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(_key(F.col("doc_id"), F.col("text")).alias("rid"), own.alias("row"))
    cut = _with_repeats(keyed, docs, width)
    text = kept_text(F.col("row.text"), F.col("repeats"), width, words)
    return cut.select("row", text.alias("kept")).select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of :func:`removed`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    @F.arrow_udf("struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string>")
    def of(text: pa.Array, repeats: pa.Array) -> pa.Array:
        rows = []
        for data, spans in _cut(text, repeats, width):
            kept = hashlib.sha256(b"".join(_rest(data or b"", spans))).hexdigest()
            rows.append({"n_bytes": len(data or b""), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": kept})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return found.select("doc_id", of("text", "repeats").alias("d")).select("doc_id", "d.*")


def _rest(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    edges = [0, *(e for s in spans for e in s), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def kept_text(text: Column, repeats: Column, width: int = WIDTH, words: int | None = None) -> Column:
    """The text without its repeated runs; null stays null. A cut inside a character drops what is left of it.

    ``words``: see :func:`without_repeats`.
    """

    def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
        if words is not None:
            spans = [(a, b) for a, b in spans if b - a >= WIDTH or len(data[a:b].split()) > words]
        return b"".join(_rest(data, spans))

    @F.arrow_udf("string")
    def of(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array((None if d is None else cut(d, s).decode("utf-8", "ignore") for d, s in _cut(texts, ranges, width)), pa.string())

    return of(text, repeats)

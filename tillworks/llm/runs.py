"""Periodic runs of words by string synchronising sets.

A batch of texts becomes one array of word numbers, texts with most words first and a number of
its own after each. For every dyadic length ``t`` a hash picks synchronising positions: those
where the least hash of a ``t``-word string within ``t + 1`` neighbouring starts stands at the
first or the last of them, strings that are themselves highly periodic (period at most ``t / 3``)
being left out. The choice depends on the next ``2 t`` words alone, so it falls on the same
places in every repetition. Two of them with equal ``2 t`` words and ``3 t`` to ``6 t`` words
apart propose that distance as a period; both ends are then carried as far as it holds.

What the sets cannot see is a period whose whole string is highly periodic itself. Then two
neighbouring runs of one smaller period touch, and every distance that lines them up is a period
of what lies around the joint; these are listed from the smaller runs. Periods 1 and 2 are read
off directly. Scales go upwards, so each finds the highly periodic regions of the next ready.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SHORTEST = 12  # words of a reported run, at least
WORDS = 1 << 18  # words handled at once; a longer text is handled alone

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * _ODD + right)


class _Strings:
    """Hashes of all strings of ``2 ** k`` words; strings that leave the array have none."""

    def __init__(self, numbers: np.ndarray):
        self.n = len(numbers)
        self.levels = [_mix(numbers.astype(np.uint64) + _ODD)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            own, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_joined(own[: max(0, len(own) - step)], own[step:]))
        return self.levels[k]

    def carried(self, at: np.ndarray, gap: np.ndarray, most: int, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it, if ``back``) equal those ``gap`` further, up to ``most``."""
        got = np.zeros(len(at), np.int64)
        for k in range(max(most, 1).bit_length(), -1, -1):
            own, step = self.level(k), 1 << k
            a = at - got - step if back else at + got
            ok = (a >= 0) & (a + gap < len(own))
            same = np.zeros(len(at), bool)
            same[ok] = own[a[ok]] == own[a[ok] + gap[ok]]
            got[same] += step
        return got


def _least(own: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` (a power of two) plus one values."""
    out, step = own, 1
    while step < width:
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        step *= 2
    return np.minimum(out[:-1], out[1:]) if len(out) > 1 else out[:0]


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks the places from ``first`` up to ``last`` (excluded) of any interval."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` items its owner and its number from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _distinct(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), the smallest period of each stretch; sorted by start, then end."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)]]
    return found


def _direct(numbers: np.ndarray, q: int) -> np.ndarray:
    """All stretches of period ``q`` and at least ``2 q`` words, from the equal neighbours."""
    same = np.r_[False, numbers[q:] == numbers[:-q], False] if len(numbers) > q else np.zeros(2, bool)
    edge = np.flatnonzero(same[1:] != same[:-1])
    first, last = edge[::2], edge[1::2] + q
    keep = last - first >= 2 * q
    return np.stack([first[keep], last[keep], np.full(keep.sum(), q)], 1)


def _synchronised(strings: _Strings, t: int, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gap): pairs of synchronising positions with equal ``2 t`` words, ``3 t`` to ``6 t`` words apart."""
    k = t.bit_length() - 1
    none = np.uint64(2**64 - 1)
    own = strings.level(k)[: max(0, n - t + 1)].copy()
    periodic = known[(known[:, 2] * 3 <= t) & (known[:, 1] - known[:, 0] >= t)]
    if len(periodic):
        own[_covered(len(own), periodic[:, 0], periodic[:, 1] - t + 1)] = none
    least = _least(own, t)
    chosen = np.flatnonzero(((own[: len(least)] == least) | (own[t : t + len(least)] == least)) & (least != none))
    context = strings.level(k + 1)[chosen]
    order = np.argsort(context, kind="stable")
    at, context = chosen[order], context[order]
    places, gaps, far = [at[:0]], [at[:0]], np.arange(len(at))
    # Equal contexts are over t / 3 words apart, or they would be highly periodic: some 18 steps at most reach 6 t.
    for step in range(1, len(at)):
        far = far[far + step < len(at)]
        gap = at[far + step] - at[far]
        near = (context[far + step] == context[far]) & (gap < 6 * t)
        far, gap = far[near], gap[near]
        if not len(far):
            break
        wide = gap >= 3 * t
        places.append(at[far[wide]])
        gaps.append(gap[wide])
    return np.concatenate(places), np.concatenate(gaps)


def _around_joints(numbers: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gap) for periods whose string is itself periodic, from touching runs of one smaller period.

    With runs [b1, e1) and [b2, e2) of period p, b2 <= e1, a distance q that lines up their words
    is fixed modulo p; it can hold for 2 q words only if q is at most either run's length and
    half of both together.
    """
    long = known[known[:, 1] - known[:, 0] >= 3 * known[:, 2]]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    one, two = long[:-1], long[1:]
    touch = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1])
    (b1, e1, p), (b2, e2, _) = one[touch].T, two[touch].T
    owner, turn = _spread(p)  # which turn of the first period string starts the second run?
    good = np.ones(len(owner), bool)
    at, off = np.arange(len(owner)), 0
    while len(at := at[off < p[owner[at]]]):  # word by word, only the turns that still agree
        o = owner[at]
        differ = numbers[b1[o] + (turn[at] + off) % p[o]] != numbers[b2[o] + off]
        good[at[differ]] = False
        at, off = at[~differ], off + 1
    owner, turn = owner[good], turn[good]
    p, b1, e1, b2, e2 = (x[owner] for x in (p, b1, e1, b2, e2))
    first = (b2 - b1 - turn) % p
    first[first == 0] = p[first == 0]
    largest = np.minimum(np.minimum(e1 - b1, e2 - b2), (e2 - b1) // 2)
    owner, nth = _spread(np.maximum(0, (largest - first) // p + 1))
    gap = first[owner] + nth * p[owner]
    return np.maximum(b1[owner], b2[owner] - gap), gap


def _stretched(strings: _Strings, at: np.ndarray, gap: np.ndarray, most: int) -> np.ndarray:
    """Stretches of period ``gap`` around each place, carried both ways as far as it holds; those of two periods and more."""
    first = at - strings.carried(at, gap, most, True)
    last = at + gap + strings.carried(at, gap, most, False)
    keep = last - first >= 2 * gap
    return np.stack([first[keep], last[keep], gap[keep]], 1)


def runs_of(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of at least two periods, of texts laid end to end.

    ``lengths`` falls from text to text; ``numbers`` holds each text's words and one number that
    stands nowhere else. Equality of long strings is that of their 64-bit hashes.
    """
    strings = _Strings(numbers)
    ends = np.cumsum(lengths + 1)
    found = _distinct(np.concatenate([_direct(numbers, 1), _direct(numbers, 2)]))
    t = 1
    while fit := int((lengths >= 6 * t).sum()):  # texts that can hold two periods of 3 t words
        n = int(ends[fit - 1])
        inside = found[found[:, 1] <= n]
        joints = _around_joints(numbers, inside[(inside[:, 2] * 3 <= t) & (inside[:, 2] * 6 > t)])
        pairs = [np.concatenate(x) for x in zip(_synchronised(strings, t, n, inside), joints, strict=True)]
        found = _distinct(np.concatenate([found, _stretched(strings, *pairs, int(lengths[0]))]))
        t *= 2
    return found


def _batch(texts: list[bytes | None], shortest: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """Word counts, reported runs and collapsed texts of a few whole texts."""
    words = [(t or b"").split() for t in texts]
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    lengths = np.array([len(words[i]) for i in order], np.int64)
    numbers = np.empty(int(lengths.sum()) + len(order), np.int64)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    for i, at in zip(order, firsts, strict=True):
        numbers[at : at + len(words[i])] = np.fromiter(map(seen.__getitem__, words[i]), np.int64, len(words[i]))
    numbers[firsts + lengths] = -1 - np.arange(len(order))
    found = runs_of(numbers, lengths)
    size = found[:, 1] - found[:, 0]
    found = found[(size >= shortest) & (size >= 2 * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    dropped = _covered(len(numbers), found[:, 0] + found[:, 2], found[:, 1])
    owner = np.searchsorted(firsts, found[:, 0], side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(order) + 1))
    runs: list[list[dict]] = [[] for _ in words]
    texts_out = [b""] * len(words)
    for j, i in enumerate(order):
        at, own = firsts[j], found[cut[j] : cut[j + 1]]
        if len(own):
            runs[i] = [{"start": int(s - at), "length": int(e - s), "period": int(q)} for s, e, q in own]
            gone = dropped[at : at + len(words[i])]
            texts_out[i] = b" ".join([w for w, g in zip(words[i], gone.tolist(), strict=True) if not g])
        else:
            texts_out[i] = b" ".join(words[i])
    return [len(w) for w in words], runs, texts_out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _portions(texts: list[bytes | None], most: int) -> Iterator[slice]:
    """Slices of about ``most`` words (a word and its space taken as six bytes), one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        own = len(t or b"") // 6 + 1
        if i > start and size + own > most:
            yield slice(start, i)
            start, size = i, 0
        size += own
    if start < len(texts):
        yield slice(start, len(texts))


def with_runs(rows: DataFrame, keep: list[str], shortest: int = SHORTEST) -> DataFrame:
    """The columns ``keep`` of ``rows`` with what repeats in its ``text``: n_words, runs and collapsed.

    ``runs`` (start, length, period; words from 0) lists, by start and period, every stretch of
    consecutive words of smallest period ``period`` and at least ``shortest`` words and two
    periods that no neighbouring word extends. ``collapsed`` is the text, words joined by one space, without what
    any run holds after its first period. Words are split at ASCII white space. Null and empty
    texts have no words, no runs and an empty ``collapsed``. Every row is answered for itself,
    repeated rows and null ids too; other columns may have any name. Memory follows the
    longest text, which one task holds whole.
    """
    own = rows.select(F.struct(*keep).alias("own"), F.col("text").cast("binary").alias("text"))
    schema = StructType([own.schema["own"], *StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary").fields])

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            texts = f.column("text").to_pylist()
            for at in _portions(texts, WORDS):
                counts, runs, collapsed = _batch(texts[at], shortest)
                arrays = [f.column("own").slice(at.start, at.stop - at.start), pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["own", "n_words", "runs", "collapsed"])

    return own.mapInArrow(work, schema).select("own.*", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a repetition written into one document in ten, as its doc_id's checksum says.

    From word ``a`` on, such a text goes round in its next ``p`` words until it has as many words as before.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    around = F.flatten(F.array_repeat(F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int")), turns))
    again = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(around, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and checksums of all runs and of the collapsed text."""
    longest = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("best", longest).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

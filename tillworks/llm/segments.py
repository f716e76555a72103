"""SentencePiece encoding by sampling: Gumbel top-k segmentations without replacement, and decoding.

A text's pieces never cross the word mark, so its lattice is the product of its words' lattices.
Each word's arcs carry the log weights of the pieces; with backward sums every arc
has its probability. A perturbed A-star search runs over prefixes of segmentations: a node is a
set of segmentations that share a prefix, its key is the largest Gumbel-perturbed
log-probability in the set, which is an exact bound, so nodes leave the queue in the order of
the perturbed log-probabilities and the first k complete ones are a sample of k distinct
segmentations without replacement. The random numbers depend on the row key alone.

The texts of a block are searched side by side: the lattices of its new words are built, and its
words are drawn, by a few passes over flat arrays.

The vocabulary is byte-fallback BPE, which ranks its pieces and stores no probabilities; a
piece's weight is taken as ``1 / (rank + SHIFT)``, sharpened by ``alpha``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SHIFT = 10.0
WORDS, TEXTS = 1 << 17, 512  # words and texts of a block; a longer text is a block of its own
LONG = 64  # characters of one lattice; longer words are cut there, the cut is part of the text
K, ALPHA = 3, 2.0
LEAD = 512  # words of a path looked at first for nodes that can be reached
TRIES = 10_000  # draws for a segmentation that is not excluded, before those left are gone through in order
FACTORS = np.random.Generator(np.random.Philox(key=1)).integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a SentencePiece model: ids, log weights and byte fallbacks, and the pieces as a tree of characters."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.bytes, self.text = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.text[i] = piece.encode()
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.longest = max(map(len, self.ids))
        ranked = sorted(self.ids.values(), key=lambda i: -sp.get_score(i))
        self.weights = np.zeros(sp.get_piece_size())
        self.weights[ranked] = -alpha * np.log(np.arange(len(ranked)) + SHIFT)
        # A byte is worth less than any piece, so fallbacks are used where nothing else fits.
        self.byte_weight = -alpha * float(np.log(len(ranked) + SHIFT)) * 2
        self._plant()

    def _plant(self) -> None:
        letters = sorted({ord(c) for piece in self.ids for c in piece})
        self.codes = np.zeros(letters[-1] + 2, np.int64)  # 0: in no piece
        self.codes[letters] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        children: dict[int, int] = {}
        pieces = [-1]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                key = at * self.letters + int(self.codes[ord(c)])
                at = children.setdefault(key, len(pieces))
                if at == len(pieces):
                    pieces.append(-1)
            pieces[at] = i
        self.piece = np.array(pieces, np.int32)
        keys, nodes = np.array(list(children), np.int64), np.array(list(children.values()), np.int32)
        self.inner = np.zeros(len(pieces), bool)
        self.inner[keys // self.letters] = True
        # Children by (node, letter) in a table with open places.
        bits = (3 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table, self.child = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            own = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[own]], self.child[slot[own]] = keys[own], nodes[own]
            left = left[self.table[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * GOLDEN >> self.shift).astype(np.int64)

    def children(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by its letter, -1 if there is none."""
        keys = nodes * np.int64(self.letters) + codes
        slot = self._slot(keys)
        held = self.table[slot]
        out = np.where(held == keys, self.child[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            held = self.table[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Lattices:
    """Lattices of some distinct words, in flat arrays.

    A place is a character of a word; ``starts`` are those of the words' first ones. Its arcs, longer ones first, stand side by
    side from ``first[place]`` on: the piece's id (fallback bytes: minus the code point, less one), the place behind it (-1: the
    word's end), its log-probability given the place, and the probability that a draw takes off; the last arc takes what is left.
    Places are ordered by their distance from the word's end, so the backward sums of one distance are one pass.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, v: Vocabulary):
        self.v = v
        n, stop = len(points), np.cumsum(sizes)
        away = (np.repeat(stop, sizes) - np.arange(n)).astype(np.int16)
        place = np.empty(n, np.int32)
        place[np.argsort(away, kind="stable")] = np.arange(n, dtype=np.int32)
        self.starts = place[stop - sizes]
        found = self._pieces(points, away)

        counts = np.zeros(n, np.int32)
        at = [place[own] for own, _ in found]
        for p in at:
            counts[p] += 1
        self.first = first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        free, self.ids, self.ends = first[:-1].copy(), np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        behind = np.concatenate([place, np.full(v.longest, -1, np.int32)])
        for length in range(len(found), 0, -1):
            own, piece = found[length - 1]
            p = at[length - 1]
            j = free[p]
            free[p] = j + 1
            self.ids[j] = piece
            self.ends[j] = np.where(away[own] == length, -1, behind[own + length])
        weight = v.weights[np.maximum(self.ids, 0)]
        bare = np.flatnonzero(self.ids < 0)
        weight[bare] = v.byte_weight * _width(-1 - self.ids[bare])

        back = np.zeros(n + 1)  # the last one, reached by -1, is the end of all words
        self.log, self.take = np.empty(len(weight)), np.empty(len(weight))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(away, minlength=2)[1:])]).tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = slice(first[lo], first[hi])
            cuts, many = first[lo:hi] - first[lo], counts[lo:hi]
            x = weight[own] + back[self.ends[own]]
            top = np.maximum.reduceat(x, cuts)
            e = np.exp(x - np.repeat(top, many))
            mass = np.add.reduceat(e, cuts)
            total = top + np.log(mass)
            back[lo:hi] = total
            self.log[own] = x - np.repeat(total, many)
            self.take[own] = e / np.repeat(mass, many)
        self.take[first[1:] - 1] = 2.0

    def _pieces(self, points: np.ndarray, away: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length from 1 on: the characters where a piece of it begins, and the pieces' ids."""
        v, n = self.v, len(points)
        codes = v.codes[np.minimum(points, len(v.codes) - 1)]
        found, at, node = [], np.arange(n), np.zeros(n, np.int64)
        for length in range(1, v.longest + 1):
            node = v.children(node, codes[at + length - 1])
            hit = np.flatnonzero(node >= 0)
            at, node = at[hit], node[hit]
            ids = v.piece[node]
            whole = np.flatnonzero(ids >= 0)
            found.append((at[whole], ids[whole]))
            if length == 1 and len(whole) < n:
                bare = np.ones(n, bool)
                bare[at[whole]] = False
                bare = np.flatnonzero(bare)
                found[0] = np.concatenate([found[0][0], bare]), np.concatenate([found[0][1], (-1 - points[bare].astype(np.int64)).astype(np.int32)])
            on = np.flatnonzero(v.inner[node] & (away[at] > length))
            at, node = at[on], node[on]
            if not len(at):
                break
        return found

    def draw(self, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A random segmentation of each word that starts at ``at``: ids in a row, where each word's begin (and the end), log-probabilities.

        The numbers of a word are SplitMix64's from its seed. Equal words are drawn side by side, as they read the same arcs.
        """
        n, who = len(at), np.argsort(at)
        at, seeds = at[who], seeds[who]
        logs, counts, steps = np.zeros(n), np.zeros(n, np.int64), []
        total, take = np.zeros(n), self.take
        while len(who):
            seeds = seeds + GOLDEN
            z = seeds ^ seeds >> np.uint64(30)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(27)
            z *= np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            j = self.first[at]
            over = (z >> np.uint64(11)) * 2.0**-53 - take[j]
            on = np.flatnonzero(over >= 0)
            over = over[on]
            while len(on):
                j[on] += 1
                over -= take[j[on]]
                more = over >= 0
                on, over = on[more], over[more]
            steps.append((who, self.ids[j]))
            total = total + self.log[j]
            at = self.ends[j]
            go = at >= 0
            done = np.flatnonzero(~go)
            own = who[done]
            logs[own], counts[own] = total[done], len(steps)
            on = np.flatnonzero(go)
            who, at, seeds, total = who[on], at[on], seeds[on], total[on]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.int32)
        for s, (who, own) in enumerate(steps):
            out[offsets[who] + s] = own
        return *self._bytes(out, offsets), logs

    def _bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points that no piece holds as the ids of their bytes."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, offsets
        point = -1 - ids[bare]
        width = _width(point)
        size = np.ones(len(ids), np.int64)
        size[bare] = width
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        for k in range(4):
            has = width > k
            p, w = point[has], width[has]
            part = p >> 6 * (w - 1 - k)
            byte = part & 0x3F | 0x80 if k else part | np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
            out[begin[bare[has]] + k] = self.v.byte_ids[byte]
        return out, begin[offsets]

    def others(self, at: int, gone: dict) -> tuple[np.ndarray | None, float]:
        """A segmentation of the word at ``at`` that is not in ``gone``, found in order by depth; for words whose rest has next to no mass."""
        stack = [(int(at), [], 0.0)]
        while stack:
            place, own, total = stack.pop()
            if place < 0:
                found, _ = self._bytes(np.array(own, np.int32), np.array([0, len(own)]))
                if found.tobytes() not in gone:
                    return found, total
                continue
            stack.extend((int(self.ends[j]), [*own, int(self.ids[j])], total + float(self.log[j])) for j in range(self.first[place], self.first[place + 1]))
        return None, 0.0


def _width(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Lattice:
    """Arcs of one word: for each character (ends, ids, log-probabilities given the place)."""

    def __init__(self, word: str, v: Vocabulary):
        own, n = Lattices(_points(word), np.array([len(word)]), v), len(word)
        self.arcs = []
        for p in range(n - 1, -1, -1):  # the place of character a is n - 1 - a
            arcs = slice(own.first[p], own.first[p + 1])
            self.arcs.append(([n - 1 - int(e) if e >= 0 else n for e in own.ends[arcs]], own.ids[arcs].tolist(), own.log[arcs]))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> tuple[Vocabulary, dict]:
    return Vocabulary(path, alpha), {}


def decode(ids, path: str, alpha: float = ALPHA) -> str:
    """The text of a sequence of ids: exactly what was encoded, but for a word mark in it, which reads as a space."""
    v, _ = vocabulary(path, alpha)
    text = b"".join(v.text[int(i)] for i in ids).decode("utf-8", "surrogatepass").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _gumbel_below(phi: np.ndarray, top: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of locations ``phi`` given that they are at most ``top``."""
    g = phi - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))
    return -np.logaddexp(-top, -g)


def sample(text: str | None, key: int, path: str, k: int = K, alpha: float = ALPHA) -> list[tuple[np.ndarray, float, float, float]]:
    """Up to ``k`` distinct segmentations of a whole text: (ids, log-probability, perturbed log-probability, inclusion score).

    In order of the perturbed log-probability G. The inclusion score of all but the last is the
    probability that a segmentation of its log-probability beats the last one's G, ``1 - exp(-exp(logp - G_k))``;
    where fewer than k exist, all are certain and score 1. Null and empty texts have one empty segmentation.
    """
    return next(samples([text], [key], path, k, alpha))[0]


def samples(texts: list[str | None], keys: list[int], path: str, k: int = K, alpha: float = ALPHA) -> Iterator[list[list[tuple]]]:
    """``sample`` of many texts, block by block; a text's result does not depend on the others."""
    v, _ = vocabulary(path, alpha)
    begin, size = 0, 0
    for i, text in enumerate(texts):
        own = len(text or "") // 6
        if i > begin and (size + own > WORDS or i - begin == TEXTS):
            yield _search(texts[begin:i], keys[begin:i], v, k)
            begin, size = i, 0
        size += own
    if begin < len(texts):
        yield _search(texts[begin:], keys[begin:], v, k)


class _Words:
    """The words of a block: each goes from the mark of the space before it to the next, over-long ones are cut every ``LONG`` characters.

    Lattices are built for the distinct words of up to ``2 * WORDS`` words at a time.
    """

    def __init__(self, texts: list[str | None], v: Vocabulary):
        self.v, self.held = v, (-1, None, None)
        texts = [text or "" for text in texts]
        points = _points("".join(MARK + text for text in texts if text)).copy()
        points[points == ord(" ")] = ord(MARK)
        starts = np.flatnonzero(points == ord(MARK))
        sizes = np.diff(starts, append=len(points))
        if len(sizes) and sizes.max() > LONG:
            cuts = -(-sizes // LONG)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            starts = np.repeat(starts, cuts) + nth * LONG
            sizes = np.diff(starts, append=len(points))
        self.points, self.starts, self.sizes = points, starts, sizes
        ends = np.cumsum([len(text) + (text != "") for text in texts])
        self.begins = np.concatenate([[0], np.searchsorted(starts, ends)])  # of the texts, and the end
        self.step = 2 * WORDS

    def part(self, n: int) -> tuple[Lattices, np.ndarray]:
        """The lattices of part ``n`` and the first place of each of its words."""
        if self.held[0] != n:
            starts, sizes = (a[n * self.step : (n + 1) * self.step] for a in (self.starts, self.sizes))
            own, which = _distinct(self.points, starts, sizes)
            lattices = Lattices(self.points[_spread(starts[own], sizes[own])], sizes[own], self.v)
            self.held = n, lattices, lattices.starts[which]
        return self.held[1], self.held[2]

    def draw(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``Lattices.draw`` for the words ``which``, in ascending order."""
        parts, ids, logs, offsets, size = range(-(-len(self.starts) // self.step)), [], [], [np.zeros(1, np.int64)], 0
        cuts = np.searchsorted(which, np.arange(len(parts) + 1) * self.step)
        for n in parts:
            own = slice(cuts[n], cuts[n + 1])
            if cuts[n] < cuts[n + 1]:
                lattices, at = self.part(n)
                drawn, bounds, log = lattices.draw(at[which[own] - n * self.step], seeds[own])
                ids.append(drawn)
                offsets.append(bounds[1:] + size)
                logs.append(log)
                size += len(drawn)
        if not ids:
            return np.zeros(0, np.int32), offsets[0], np.zeros(0)
        return np.concatenate(ids), np.concatenate(offsets), np.concatenate(logs)

    def others(self, word: int, gone: dict) -> tuple[np.ndarray | None, float]:
        lattices, at = self.part(word // self.step)
        return lattices.others(at[word % self.step], gone)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The characters of some words, in a row."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _distinct(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one word of each kind, the kind of each word). Words are sorted by a hash and then compared with their kind's."""
    whole = _spread(starts, sizes)
    own, begins = points[whole], np.cumsum(sizes) - sizes
    hashed = np.add.reduceat(own * FACTORS[whole - np.repeat(starts, sizes)], begins) + sizes.astype(np.uint64) * GOLDEN
    order = np.argsort(hashed)
    hashed = hashed[order]
    first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
    kinds, which = order[first], np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    same = sizes[kinds[which]] == sizes
    equal = np.ones(len(own), bool)
    if same.all():
        equal = points[_spread(starts[kinds[which]], sizes)] == own
    if not (same.all() and equal.all()):  # two kinds share a hash: every word counts as its own
        return np.arange(len(starts)), np.arange(len(starts))
    return kinds, which


class _Text:
    """One text's search: its words' place in the block, its random numbers, its paths and what was found."""

    def __init__(self, begin: int, words: int, key: int):
        self.begin, self.words = begin, words
        self.rng = np.random.Generator(np.random.Philox(key=key & (1 << 64) - 1))
        self.top = float(-np.log(-np.log(max(self.rng.random(), 1e-300))))  # the largest perturbed value of all: Gumbel of location 0
        self.low = -np.inf  # no node with less mass than this can be reached
        self.paths: list[_Path] = []
        self.out: list[tuple[_Path, float]] = []
        self.kappa: float | None = None  # the value of the one after the last; none where no more exist

    def lower(self, logs: np.ndarray, k: int) -> None:
        """Sets ``low`` by the first path. A node's value lies at most 37 above its location, as the numbers stay 1e-16 below 1, and
        at most 7.5 below that or the first path's value, as they are at least 1e-300: ``k`` locations of some words say below which
        no other node is reached."""
        some = logs[: max(LEAD, 2 * k)]
        phi = _locations(np.concatenate([[0.0], np.cumsum(some)[:-1]]), some)
        if len(phi) > k:
            self.low = min(self.top, float(np.partition(phi, len(phi) - k)[-k])) - 7.5 - 37.0

    def uniform(self, n: int) -> np.ndarray:
        return self.rng.random(n)

    def seeds(self, n: int) -> np.ndarray:
        return self.rng.bit_generator.random_raw(n)

    def found(self) -> list[tuple[np.ndarray, float, float, float]]:
        if self.kappa is None:  # the whole set was emitted
            return [(p.ids, p.total, g, 1.0) for p, g in self.out]
        return [(p.ids, p.total, g, float(-np.expm1(-np.exp(min(50.0, p.total - self.kappa))))) for p, g in self.out]


def _search(texts: list[str | None], keys: list[int], v: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """The first ``k`` segmentations of the perturbed search of each text (fewer if no more exist).

    A path fixes one segmentation for each word. Leaving path r at word i, with the word's
    segmentations seen there excluded, is a node of mass (prefix) * (1 - excluded); its largest
    perturbed value given the path's own is a truncated Gumbel variable. The texts take their
    rounds together, so that the words of all are drawn at once.
    """
    words = _Words(texts, v)
    every = [_Text(int(a), int(b - a), key) for a, b, key in zip(words.begins[:-1], words.begins[1:], keys, strict=True)]
    new = []
    for t, (ids, offsets, logs) in zip(every, _rests(words, [(t, 0) for t in every]), strict=True):
        t.lower(logs, k)
        new.append((t, _Path(ids, offsets, logs, 0, 0.0), t.top))
    _open(new)
    live = every
    for _ in range(k):
        left = []
        for node in _leave(words, live):
            if len(node[0].out) == k:  # only the value of this one is asked
                node[0].kappa = node[3]
            else:
                left.append(node)
        new = []
        for (t, best, i, g, choice, logp), (ids, offsets, logs) in zip(left, _rests(words, [(t, i + 1) for t, _, i, *_ in left]), strict=True):
            at = int(best.offsets[i])
            ids = np.concatenate([best.ids[:at], choice, ids])
            offsets = np.concatenate([best.offsets[: i + 1], offsets + (at + len(choice))])
            new.append((t, _Path(ids, offsets, np.concatenate([[logp], logs]), i, best.prefix(i)), g))
            best.split(i, choice, logp, g, t)
        _open(new)
        for t, path, _ in new:
            path.close(path.first)
        live = [t for t, *_ in left]
    return [t.found() for t in every]


def _open(paths: list[tuple[_Text, _Path, float]], lead: int = LEAD) -> None:
    """Adds paths to their texts, with the nodes that can be reached: sums fall from word to word, so these lead the others."""
    if not paths:
        return
    width = min(lead, max(len(path.logs) for _, path, _ in paths))
    logs, sizes = np.zeros((len(paths), width)), np.zeros(len(paths), np.int64)
    for r, (_, path, _) in enumerate(paths):
        sizes[r] = min(width, len(path.logs))
        logs[r, : sizes[r]] = path.logs[:width]
    sums = np.zeros((len(paths), width + 1))
    np.cumsum(logs, axis=1, out=sums[:, 1:])
    sums += np.array([[path.start] for _, path, _ in paths])
    low = np.array([[t.low] for t, *_ in paths])
    on = (sums[:, :-1] >= low) & (np.arange(width) < sizes[:, None])
    on[:, :1] = sizes[:, None] > 0
    more = [r for r, (_, path, _) in enumerate(paths) if len(path.logs) > width and on[r, -1]]
    on[more] = False
    phi = _locations(sums[:, :-1][on], logs[on])
    many = on.sum(axis=1)
    cuts = np.concatenate([[0], np.cumsum(many)]).tolist()
    u = np.concatenate([t.uniform(m) for (t, *_), m in zip(paths, many.tolist(), strict=True)])
    bounds = np.full(len(phi), -np.inf)
    at = np.flatnonzero(np.isfinite(phi))
    bounds[at] = _gumbel_below(phi[at], np.repeat([g for *_, g in paths], many)[at], u[at])
    later = set(more)
    for r, (t, path, g) in enumerate(paths):
        if r in later:
            _open([(t, path, g)], len(path.logs))
        else:
            path.open(sums[r], bounds[cuts[r] : cuts[r + 1]])
            t.paths.append(path)
            t.out.append((path, g))


def _rests(words: _Words, asked: list[tuple[_Text, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Draws each text's words from the given one on: ids, offsets and log-probabilities."""
    if not asked:
        return
    which = [np.arange(t.begin + i, t.begin + t.words) for t, i in asked]
    ids, offsets, logs = words.draw(np.concatenate(which), np.concatenate([t.seeds(t.words - i) for t, i in asked]))
    at = 0
    for own in which:
        o = offsets[at : at + len(own) + 1]
        yield ids[o[0] : o[-1]], o - o[0], logs[at : at + len(own)]
        at += len(own)


def _leave(words: _Words, texts: list[_Text]) -> list[tuple]:
    """For each text its best node and another segmentation of the word there; texts without a node left are left out.

    In the order of the texts: (text, path, word, perturbed value, the word's ids, their log-probability).
    """
    out, asked = {}, texts
    while asked:
        todo = []
        for t in asked:
            best = max(t.paths, key=_Path.bound)
            if np.isfinite(best.bound()):
                todo.append((t, best, best.where(), best.bound()))
        asked = []
        for (t, best, i, g), (choice, logp) in zip(todo, _choices(words, todo), strict=True):
            if choice is None:
                best.close(i)
                asked.append(t)
            else:
                out[id(t)] = t, best, i, g, choice, logp
    return [out[id(t)] for t in texts if id(t) in out]


def _choices(words: _Words, nodes: list[tuple]) -> list[tuple[np.ndarray | None, float]]:
    """A segmentation of each node's word that its path has not excluded."""
    out: list = [None] * len(nodes)
    left, tried, tries = list(range(len(nodes))), 0, 8
    while left and tried < TRIES:
        over = []
        for a in range(0, len(left), 256):
            some = left[a : a + 256]
            which = np.repeat([nodes[m][0].begin + nodes[m][2] for m in some], tries)
            ids, offsets, logs = words.draw(which, np.concatenate([nodes[m][0].seeds(tries) for m in some]))
            for c, m in enumerate(some):
                gone = nodes[m][1].excluded(nodes[m][2])
                for r in range(c * tries, (c + 1) * tries):
                    own = ids[offsets[r] : offsets[r + 1]]
                    if own.tobytes() not in gone:
                        out[m] = own, float(logs[r])
                        break
                else:
                    over.append(m)
        left, tried, tries = over, tried + tries, min(8 * tries, 1024)
    for m in left:
        out[m] = words.others(nodes[m][0].begin + nodes[m][2], nodes[m][1].excluded(nodes[m][2]))
    return out


def _locations(prefixes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log-mass of the other segmentations of each word behind its prefix; none where the word has but one."""
    with np.errstate(divide="ignore"):
        other = np.log(-np.expm1(np.minimum(logs, 0.0)))
    return prefixes + np.where(logs > -1e-12, -np.inf, other)


class _Path:
    """A complete segmentation, and its open nodes: the word where another segmentation would leave it."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, logs: np.ndarray, first: int, start: float):
        self.ids, self.offsets, self.logs, self.first, self.start = ids, offsets, logs, first, start
        self.total = start + float(logs.sum())
        self.gone: dict[int, dict] = {}

    def open(self, sums: np.ndarray, bounds: np.ndarray) -> None:
        self.sums, self.bounds = sums, bounds
        self._best()

    def _best(self) -> None:
        self.at = int(self.bounds.argmax()) if len(self.bounds) else -1

    def bound(self) -> float:
        return float(self.bounds[self.at]) if self.at >= 0 else -np.inf

    def where(self) -> int:
        return self.first + self.at

    def prefix(self, i: int) -> float:
        return float(self.sums[i - self.first])

    def excluded(self, i: int) -> dict:
        own = self.ids[self.offsets[i] : self.offsets[i + 1]].tobytes()
        return self.gone.setdefault(i, {own: float(self.logs[i - self.first])})

    def close(self, i: int) -> None:
        self.bounds[i - self.first] = -np.inf
        self._best()

    def split(self, i: int, choice: np.ndarray, logp: float, top: float, text: _Text) -> None:
        """Takes ``choice`` out of the node at word ``i``; what is left gets a new bound below ``top``."""
        gone = self.excluded(i)
        gone[choice.tobytes()] = logp
        left = 1.0 - sum(map(math.exp, gone.values()))
        if left <= 1e-12:
            self.close(i)
        else:
            g = self.prefix(i) + math.log(left) - math.log(-math.log(min(max(text.rng.random(), 1e-300), 1 - 1e-16)))
            self.bounds[i - self.first] = min(top, g) - math.log1p(math.exp(-abs(top - g)))
            self._best()


def model_path() -> str:
    """The public 32k SentencePiece model on this machine."""
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def sampled(docs: DataFrame, k: int = K, alpha: float = ALPHA, path: str | None = None) -> DataFrame:
    """(doc_id, rank, ids, log_prob, perturbed, inclusion) for up to ``k`` segmentations of each whole text.

    The row key is the hash of doc_id, so a document has the same sample in every run and table;
    repeated doc_ids use the same random numbers. Null and empty texts have one empty
    segmentation. Other columns are not read.
    """
    model = path or model_path()
    out = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double"
    names = ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for start in range(0, f.num_rows, 4 * TEXTS):
                part = f.slice(start, 4 * TEXTS).to_pydict()
                at = 0
                for block in samples(part["text"], part["key"], model, k, alpha):
                    ids = [own for found in block for own, *_ in found]
                    rows = [(doc, r, *own[1:]) for doc, found in zip(part["doc_id"][at:], block, strict=False) for r, own in enumerate(found, 1)]
                    at += len(block)
                    docs_, ranks, *values = zip(*rows, strict=True)
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    arrays = [pa.array(docs_, pa.int64()), pa.array(ranks, pa.int32()), pa.ListArray.from_arrays(offsets, np.concatenate(ids))]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.float64()) for c in values)], names=names)

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id").alias("key"), F.col("text").cast("string"))
    return own.mapInArrow(run, out)


def digest(found: DataFrame) -> DataFrame:
    """Ids as their number and CRC-32 (little-endian 32-bit)."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(lambda a: zlib.crc32(np.asarray(a, "<u4").tobytes())).astype("int64")

    return found.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), crc("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion"
    )

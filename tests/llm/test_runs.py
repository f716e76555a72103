"""Periodic runs against a brute-force version."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from tillworks.llm import catalog, runs

SCHEMA = "doc_id long, text string, own struct<x:int>, n long, g long, words string, runs string, collapsed string"


def brute(words, shortest=12):
    """(start, end, smallest period) of every maximal stretch, one distance after the other."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - at >= max(shortest, 2 * q):
                found.setdefault((at, end), q)
            at = max(at + 1, end - q + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def all_runs(texts):
    texts = sorted(texts, key=len, reverse=True)
    numbers = [x for i, t in enumerate(texts) for x in [*t, -1 - i]]
    found = runs.runs_of(np.array(numbers, np.int64), np.array([len(t) for t in texts], np.int64))
    want, at = [], 0
    for t in texts:
        want += [(s + at, e + at, q) for s, e, q in brute(t, 2)]
        at += len(t) + 1
    return sorted(map(tuple, found.tolist())), sorted(want)


def nested(rng, n):
    """Repetitions of repetitions, some broken off, some with a slip between them."""
    out = list(rng.integers(0, 2, int(rng.integers(1, 5))))
    while len(out) < n:
        out = out * int(rng.integers(1, 6))
        kind = rng.random()
        if kind < 0.4:
            out += list(rng.integers(0, 2, int(rng.integers(0, 3))))
        elif kind < 0.6:
            out = out[: int(rng.integers(1, len(out) + 1))] + out
        elif kind < 0.8:
            out += out[int(rng.integers(0, len(out))) :]
    return out[:n]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_hard_strings(seed):
    rng = np.random.default_rng(seed)
    texts = [nested(rng, int(rng.integers(0, 400))) for _ in range(8)] + [list(rng.integers(0, 2, 90)), list(rng.integers(0, 3, 60))]
    got, want = all_runs([*texts, fibonacci(int(rng.integers(1, 400))), [0] * 50, []])
    assert got == want


@pytest.mark.parametrize("n", [1, 5, 9, 12])
def test_runs_of_every_short_string(n):
    got, want = all_runs([list(x) for x in itertools.product([0, 1], repeat=n)])
    assert got == want


def test_a_joint_of_long_periodic_strings():
    """Periods between 48 and 96 whose whole string has period 4: only the joint of two runs shows them."""
    got, want = all_runs([([0, 1, 2, 3] * 40)[:n] + ([0, 1, 2, 3] * 40)[:m] for n, m in [(61, 67), (75, 66), (160, 159), (50, 151)]])
    assert got == want


def row_of(doc_id, text):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    words = (text or "").encode().split()
    n = len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda r: (r[0], r[2])))
    gone = {i for s, e, q in found for i in range(s + q, e)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.queries()["op11_synchronised_runs"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(row_of(*r) for r in docs)


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, white space of every kind, clashing names."""
    line = "one two three "
    texts = [None, "", " \n\t ", line * 9, line * 9, "a b " * 20, "é\x0bß\x0c" * 30, "x " * 11, "x " * 12, "no repeats here", "w1 w2 " + line * 900 + "end", "ab " * 5 + "b " * 30]
    data = [(i, t, (i,), 1, 2, "w", "r", "c") for i, t in enumerate(texts)]
    data += [data[3], (None, line * 6, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = runs.with_runs(docs, ["doc_id", "own", "n"])
    assert found.columns == ["doc_id", "own", "n", "n_words", "runs", "collapsed"]
    got = {r.doc_id: r for r in found.where("doc_id is not null").collect()}
    assert got[10].runs == [(2, 2700, 3)] and got[10].collapsed == "w1 w2 one two three end"
    assert got[0].n_words == 0 and got[0].runs == [] and got[0].collapsed == ""
    assert got[5].n_words == 20 and not got[7].runs and got[8].runs == [(0, 12, 1)]
    plain = lambda rows: sorted(rows, key=str)
    assert plain(map(tuple, runs.digest(runs.with_runs(runs.planted(docs), ["doc_id"])).collect())) == plain(row_of(r[0], r[1]) for r in data)
    assert runs.digest(runs.with_runs(runs.planted(spark.createDataFrame([], SCHEMA)), ["doc_id"])).count() == 0


def test_portions_do_not_change_the_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "p q r s " * (i % 7) + "t " * (i % 17)) for i in range(60)], "doc_id long, text string")
    whole = sorted(map(str, runs.with_runs(docs, ["doc_id"]).collect()))
    assert [len(range(*s.indices(5))) for s in runs._portions([b"x" * 60] * 5, 22)] == [2, 2, 1]
    texts = [r.text.encode() for r in docs.collect()]
    assert runs._batch(texts, 12) == tuple(sum((list(part) for part in parts), []) for parts in zip(*[runs._batch([t], 12) for t in texts], strict=True))
    assert whole

"""Ranked lexical search against a brute-force version."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import compare, duck
from tillworks.llm import catalog, ranked

DOCS = "doc_id long, text string, n long, ids string, no string, score string, rank string"
ITEMS = "item_id long, text string, no string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(docs, items, k=20):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n = sum(1 for *_, size in bags if size)
    total = sum(size for *_, size in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            score = 0
            for t, c in Counter(words(text)).items():
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += c * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * (75 + 25 * size * n // total)))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    """A skewed vocabulary, copies, ties, nulls, empty and very long texts, repeated ids on both sides."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve", "B2B", "x"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    prose = lambda size: " ".join(rng.choice(vocabulary, size, p=p / p.sum()))
    texts = [prose(int(s)) for s in rng.integers(1, 120, 400)]
    texts += [None, "", "--- ...", texts[0], texts[0].upper(), texts[1] + "!", prose(30000), "w1", "w1", "w1", "rare w299 RARE"]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)]
    docs += [docs[3], docs[3], (None, texts[5]), (None, None)]
    items = [(i, prose(int(s))) for i, s in enumerate(rng.integers(1, 40, 25))]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w1 W1"), (94, texts[0]), (94, texts[0]), (None, "rare x"), (95, "?!"), (96, prose(5000))]
    return docs, items


@pytest.mark.parametrize("parts", [1, 5])
def test_search_matches_brute_force(spark, tables, parts):
    docs, items = tables
    left = spark.createDataFrame([(*d, 1, "i", "n", "s", "r") for d in docs], DOCS).repartition(parts)
    right = spark.createDataFrame([(*i, "n", "s") for i in items], ITEMS)
    assert rows(ranked.search(left, right)) == brute(docs, items)
    # In many small blocks of items nothing changes.
    assert rows(ranked.search(left, right, k=3, item_bytes=9000)) == brute(docs, items, 3)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(tables, ["doc_id long, text string", "item_id long, text string"], strict=True))
    assert ranked.search(docs.where("false"), items).count() == 0 and ranked.search(docs, items.where("false")).count() == 0


def test_common_terms_are_skipped():
    """Rare terms decide the best documents; the bounds of a common term then rule most blocks out."""
    rng = np.random.default_rng(1)
    n = 20_000
    rare = np.sort(rng.choice(n, 30, replace=False))
    doc, term = np.r_[np.arange(n), rare], np.r_[np.zeros(n, int), np.ones(30, int)]
    shard = ranked.Shard(doc, term, np.r_[rng.integers(1, 50, n), rng.integers(1000, 1100, 30)], n, 2)
    best = ranked.Best(20)
    pad = shard.blocks * ranked.BLOCK
    skipped = shard.search([(0, 1), (1, 1)], best, np.zeros(pad, bool), np.arange(pad))
    assert skipped > 0.9 * shard.blocks and set(best.id) <= set(rare) and len(best.id) == 20


def test_whole_table(spark, folder):
    got, want = compare(duck(folder), catalog.checks()["op12_hybrid_search"], catalog.queries()["op12_hybrid_search"](spark, folder))
    assert got == want

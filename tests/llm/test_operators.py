"""The corpus operators against brute-force versions, on small tables with the awkward rows."""

import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillworks.llm import kdshards, licenses, lthash, maxent, neighbours, packing, repeats, segments, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rid long, w string, node long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéßñ"), rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, null ids."""
    rng = np.random.default_rng(7)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 300, 30)]
    shared = prose(rng, 120)
    texts += [None, "", "   ", "\n\t ", texts[3], texts[3], "x" * 3000, texts[5] + " more", shared + texts[1], texts[2] + shared, shared, prose(rng, 6000)]
    texts += ["All rights reserved. CC BY CC by, general public license", "This work is licensed under the GNU General Public License, version 3.", "cc", "A. B. A. b"]
    out = [(i, t, "en", "s", None, 1, 2, "clash", 3) for i, t in enumerate(texts)]
    out += [out[3], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1: sampled segmentations


def test_lattice_probabilities_match_all_segmentations():
    path = segments.model_path()
    v, _ = segments.vocabulary(path, 1.0)
    lattice = segments.Lattice("▁there", v)

    def every(a, p):
        if a == len(lattice.arcs):
            yield p
            return
        for b, q in zip(lattice.arcs[a][0], lattice.arcs[a][2], strict=True):
            yield from every(b, p + q)

    assert math.isclose(sum(math.exp(p) for p in every(0, 0.0)), 1.0, rel_tol=1e-9)


def test_sample_is_distinct_and_reads_back(rows):
    path = segments.model_path()
    for i, (_, text, *_rest) in enumerate(rows):
        found = segments.sample((text or "")[:400], i, path, 3)
        assert len({tuple(ids) for ids, *_ in found}) == len(found)
        assert [g for *_, g, _ in found] == sorted((g for *_, g, _ in found), reverse=True)
        assert all(segments.decode(ids, path) == (text or "")[:400] and 0 <= s <= 1 for ids, _, _, s in found)
    assert segments.sample("abc", 5, path) [0][0].tolist() == segments.sample("abc", 5, path)[0][0].tolist()


def test_first_draw_follows_the_probabilities():
    path = segments.model_path()
    seen = collections.Counter()
    logs = {}
    for key in range(3000):
        ids, p, *_ = segments.sample("an", key, path, 2, 0.5)[0]
        seen[tuple(ids)] += 1
        logs[tuple(ids)] = p
    for ids, p in logs.items():
        assert abs(seen[ids] / 3000 - math.exp(p)) < 0.05


def test_small_sets_are_emitted_whole():
    found = segments.sample("a", 1, segments.model_path(), 50)
    assert math.isclose(sum(math.exp(p) for _, p, _, _ in found), 1.0, rel_tol=1e-6) and all(s == 1.0 for *_, s in found)


def test_lattices_match_plain_sums():
    """All distinct words of a block at once against one word at a time, arc by arc."""
    v, _ = segments.vocabulary(segments.model_path(), 2.0)
    texts = ["hello  world, naïve\nstraße 🙂🙂 中文字 hello world", None, "", " ", "x" * 200 + " " + "🙂" * 70, "▁mark hello"]
    words = segments._Words(texts, v)
    whole = "".join(("▁" + t).replace(" ", "▁") for t in texts if t)
    units = [whole[a : a + n] for a, n in zip(words.starts.tolist(), words.sizes.tolist(), strict=True)]
    assert "".join(units) == whole and max(map(len, units)) == segments.LONG and words.begins.tolist()[1:5] == [8, 8, 8, 10]
    lattices, at = words.part(0)
    assert len(lattices.starts) == len(set(units))
    for word, place in zip(units, at.tolist(), strict=True):
        back = [0.0] * (len(word) + 1)
        arcs = []
        for a in range(len(word) - 1, -1, -1):
            own = [(b, v.ids[word[a:b]], v.weights[v.ids[word[a:b]]]) for b in range(a + 1, len(word) + 1) if word[a:b] in v.ids]
            if not any(b == a + 1 for b, *_ in own):
                own.append((a + 1, -1 - ord(word[a]), v.byte_weight * len(word[a].encode())))
            back[a] = float(np.logaddexp.reduce([w + back[b] for b, _, w in own]))
            arcs.append({(i, round(w + back[b] - back[a], 9)) for b, i, w in own})
        for a, want in enumerate(reversed(arcs)):
            own = range(lattices.first[place], lattices.first[place + 1])
            assert {(int(lattices.ids[j]), round(float(lattices.log[j]), 9)) for j in own} == want
            place = next(int(lattices.ends[j]) for j in own if lattices.ids[j] < 0 or len(v.text[int(lattices.ids[j])].decode()) == 1)
        assert place == -1


def test_pairs_follow_the_probabilities_without_replacement():
    path = segments.model_path()
    keys = list(range(6000))
    every = {tuple(ids): math.exp(p) for ids, p, *_ in segments.sample("an it", 1, path, 400, 0.5)}
    assert math.isclose(sum(every.values()), 1.0, rel_tol=1e-6)
    seen = collections.Counter()
    for block in segments.samples(["an it"] * len(keys), keys, path, 2, 0.5):
        seen.update((tuple(a[0]), tuple(b[0])) for a, b in block)
    assert sum(seen.values()) == len(keys)
    for a, b in itertools.permutations(every, 2):
        p = every[a] * every[b] / (1 - every[a])
        assert abs(seen[a, b] - p * len(keys)) < 5 * math.sqrt(p * len(keys)) + 3


def test_samples_do_not_depend_on_the_block(rows, monkeypatch):
    path = segments.model_path()
    texts, keys = [r[1] for r in rows], list(range(len(rows)))
    flat = lambda blocks: [[(ids.tolist(), *rest) for ids, *rest in found] for block in blocks for found in block]
    want = flat(segments.samples(texts, keys, path))
    assert [segments.decode(f[0][0], path) for f in want] == [t or "" for t in texts]
    monkeypatch.setattr(segments, "WORDS", 50)  # texts of many parts
    monkeypatch.setattr(segments, "TEXTS", 3)
    assert flat(segments.samples(texts, keys, path)) == want
    assert flat([[segments.sample(t, k, path)] for t, k in zip(texts, keys, strict=True)]) == want


def test_nodes_left_out_cannot_be_reached():
    v, _ = segments.vocabulary(segments.model_path(), 2.0)
    rng = np.random.default_rng(5)
    texts = [segments._Text(0, 0, key) for key in range(200)]
    for t in texts:
        logs = np.log(rng.uniform(0.05, 1, 400))
        t.lower(logs, 3)
        path = segments._Path(np.zeros(0, np.int32), np.zeros(1, np.int64), logs, 0, 0.0)
        segments._open([(t, path, t.top)])
        top = np.sort(path.bounds)[-3:]
        assert top[0] >= t.low + 37 and len(path.bounds) == np.count_nonzero(np.concatenate([[0], np.cumsum(logs)[:-1]]) >= t.low)


def test_texts_of_new_words_are_sampled_side_by_side():
    """36,000 distinct words; one lattice and one draw at a time took about 0.2 ms of CPU a word."""
    path = segments.model_path()
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("etaoinshrdlu"), 8)) for _ in range(600)) for _ in range(60)]
    segments.vocabulary(path, segments.ALPHA)
    start = time.process_time()
    found = [f for block in segments.samples(texts, list(range(60)), path) for f in block]
    assert time.process_time() - start < 3
    assert all(segments.decode(ids, path) == text for text, own in zip(texts, found, strict=True) for ids, *_ in own)


def test_sampled_rows(docs, rows, empty):
    got = segments.sampled(docs).collect()
    assert collections.Counter(r.doc_id for r in got if r.rank == 1) == collections.Counter(r[0] for r in rows)
    text = dict((r[0], r[1] or "") for r in rows if r[0] is not None)
    assert all(segments.decode(r.ids, segments.model_path()) == text[r.doc_id] for r in got if r.doc_id is not None)
    crc = collections.Counter((r.doc_id, r.rank, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    assert collections.Counter((r.doc_id, r["rank"], r.n_pieces, r.ids_crc32) for r in segments.digest(segments.sampled(docs)).collect()) == crc
    assert segments.sampled(empty).count() == 0


# ---- 2: SimHash


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, rows):
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, ((i, f) for i, f, _ in got))) == sorted(map(str, ((r[0], brute_print(r[1])) for r in rows)))
    least = components_of({f for _, f, _ in got}, 4)
    for _, f, c in got:
        own = [i for i, g, _ in got if least[g] == least[f] and i is not None]
        assert c == min(own, default=None)


def components_of(fps, tau):
    fps, root = list(fps), {}
    for f in fps:
        root.setdefault(f, f)
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= tau and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("block", [8192, 16])
def test_links_span_dense_groups(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for _ in range(600):
        f = int(rng.choice(centre[:3]))
        for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {f: f for f in fps}
    for r in simhash.links(df, block=block).collect():
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 4
        old, new = got[a], got[b]
        got = {k: new if v == old else v for k, v in got.items()}
    want = components_of(fps, 4)
    assert len(set(got.values())) == len(set(want.values()))


def test_one_of_each_keeps_clean_rows(docs, rows, empty):
    got = simhash.one_of_each(docs).collect()
    texts = [r.text for r in got]
    assert texts.count(rows[3][1]) == 1
    assert {r[1] for r in rows if r[0] is not None and r[0] < 30} <= set(texts)
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(empty).count() == 0


def test_outlines_bound_what_is_shared(spark):
    """The bound is never under the true number of shared shingles, on short and on very long sets."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(2**62), 2**62, n)) for n in (1, 5, 60, 300, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(-(2**62), 2**62, 1 + len(s) // 20)])) for s in sets]
    rows = spark.createDataFrame([(i, len(s), s.tolist()) for i, s in enumerate(sets)], "node long, n long, shingles array<long>")
    drawn = simhash._outlines(rows)
    met = drawn.toDF("a", "n", "x").crossJoin(drawn.toDF("b", "m", "y"))
    most = {(r.a, r.b): r.most for r in met.select("a", "b", simhash._most_shared("n", "m", "x", "y").alias("most")).collect()}
    shared = {(i, j): len(np.intersect1d(s, t)) for i, s in enumerate(sets) for j, t in enumerate(sets)}
    assert len(most) == len(shared) and all(most[p] >= n for p, n in shared.items())
    assert most[2, 3] < 30 and all(most[i, i] == len(s) for i, s in enumerate(sets))
    assert simhash._outlines(rows.limit(0)).count() == 0


def test_outlines_are_made_where_the_text_is_read(spark, monkeypatch):
    """Texts give the outlines that their sets give, and no task of the whole search hands rows from one Python worker to another."""
    rng = np.random.default_rng(19)
    base = [f"b{j}" for j in range(80)]
    rows = [(i, None if i == 3 else " ".join(base[: 80 - i] + [f"e{k}" for k in rng.integers(1 << 40, size=i % 4)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    drawn = [{(r.node, r.n, tuple(r.bits)) for r in x.collect()} for x in (simhash._outlines(docs, 5), simhash._outlines(simhash._sets(docs, 5)))]
    assert drawn[0] == drawn[1] and len(drawn[0]) > 30
    plans, stage_table = [], simhash.stage_table
    monkeypatch.setattr(simhash, "WIDE", 8)
    monkeypatch.setattr(simhash, "stage_table", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage_table(df))
    assert 0 < simhash.one_of_each(docs).count() < 40
    assert sum("MapInArrow" in p for p in plans) > 5
    assert not [p for p in plans if re.search(r"MapInArrow[^\n]*\n(?:(?!.*(?:Exchange|Scan))[^\n]*\n)*[^\n]*MapInArrow", p)]


def test_one_of_each_confirms_every_pair(spark):
    rng = np.random.default_rng(11)
    line = [f"common{k}" for k in range(12)]
    texts = []
    for k in range(40):
        own = [f"w{k}x{j}" for j in range(int(rng.integers(30, 160)))]
        texts.append(own)
        for edits in rng.integers(1, 7, 3):  # resemblances around 0.8
            copy = list(own)
            for at in rng.choice(len(own), int(edits), replace=False):
                copy[at] = f"e{rng.integers(1 << 40)}"
            texts.append(copy)
    texts += [line + [f"s{k}x{j}" for j in range(k % 6)] for k in range(90)]
    order = rng.permutation(len(texts))
    rows = [(i, " ".join(texts[j])) for i, j in enumerate(order.tolist())]
    sets = [{tuple(t.split()[p : p + 5]) for p in range(max(1, len(t.split()) - 4))} for _, t in rows]
    root = list(range(len(rows)))
    near = [0, 0]
    for a, b in itertools.combinations(range(len(rows)), 2):
        same, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        near[0] += 0.8 <= same / both < 0.85
        near[1] += 0.75 < same / both < 0.8
        if same * 5 >= 4 * both and root[a] != root[b]:
            old, new = sorted((root[a], root[b]))[::-1]
            root = [new if r == old else r for r in root]
    assert min(near) > 5
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root))


def test_large_groups_meet_inside_tasks(spark, monkeypatch):
    """A large group whose members are partly alike: groups equal brute force, and few of its pairs become rows."""
    monkeypatch.setattr(simhash, "WIDE", 8)
    monkeypatch.setattr(simhash, "MEET", 32)
    rng = np.random.default_rng(17)
    base, rows = [f"b{j}" for j in range(150)], []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(len(base), int(rng.integers(1, 6)), replace=False):
            copy[at] = f"e{rng.integers(1 << 40)}"
        rows.append((i, " ".join(copy)))
    sets = [{tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = sorted((root[a], root[b]))[::-1]
            root = [new if r == old else r for r in root]
    assert 10 < len(set(root)) < 150
    asked, confirmed = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, sets_of: asked.append(pairs.count()) or confirmed(pairs, sets_of))
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root))
    assert sum(asked) < 150 * 2 * simhash.FIRST


def test_first_shingles_let_every_alike_pair_pass(spark):
    """In any order of shingles an alike pair shares enough of its first ones; a common line alone does not."""
    rng = np.random.default_rng(13)
    rows = []
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        m = int(rng.integers(-(-4 * n // 5), 5 * n // 4 + 1))
        both = int(rng.integers(4 * min(n, m) // 5, min(n, m) + 1))
        order = rng.permutation(n + m - both)
        first = [sorted(order[a].tolist())[: k - (4 * k + 4) // 5 + 1] for a, k in ((slice(0, n), n), (slice(n - both, None), m))]
        shared = len(set(first[0]) & set(first[1]))
        rows.append((n, m, shared, 5 * both >= 4 * (n + m - both)))
    assert min(collections.Counter(r[3] for r in rows).values()) > 300
    got = spark.createDataFrame(rows, "n long, m long, shared long, alike boolean").withColumn("passes", simhash._enough())
    assert got.where("alike and not passes").count() == 0
    assert not spark.createDataFrame([(300, 300, 8)], "n long, m long, shared long").select(simhash._enough()).first()[0]


def test_one_of_each_asks_the_pigeonring(spark, monkeypatch):
    """Links of fingerprints are among the candidates that are confirmed; those that are not alike do not count."""
    own = [f"w{j}" for j in range(900)]
    near = [*own[:-1], "other"]
    line = [f"z{j}" for j in range(7)] * 200  # repeats rule the fingerprint, distinct shingles the resemblance
    rows = [(5, " ".join(own)), (3, " ".join(near)), *[(i, " ".join(line + [f"{i}y{j}" for j in range(30)])) for i in (9, 7)]]
    asked, found = [], []
    links, confirmed = simhash.links, simhash._confirmed
    monkeypatch.setattr(simhash, "links", lambda prints, *a, **k: asked.append(prints) or links(prints, *a, **k))
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, sets_of: found.append(pairs) or confirmed(pairs, sets_of))
    prints = [simhash.fingerprint_of(t, 4) for _, t in rows]
    node = {i: simhash.name_of(simhash.shingles_of(t, 5)) for i, t in rows}
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [3, 7, 9]
    assert len(asked) == 1 and {r.fp for r in asked[0].collect()} == set(prints)
    near_prints = sum((a ^ b).bit_count() <= 4 for a, b in itertools.combinations([p & (1 << 64) - 1 for p in prints], 2))
    assert near_prints == 2 and {(r.a, r.b) for r in found[0].collect()} == {tuple(sorted(p)) for p in ((node[5], node[3]), (node[9], node[7]))}


# ---- 3: toxicity


def test_held_out_accuracy():
    rng = np.random.default_rng(1)
    bad, words = ["grumph", "zorkel"], [prose(rng, 1) for _ in range(300)]
    texts, toxic = [], []
    for i in range(900):
        own = list(rng.choice(words, 40))
        if i % 5 == 0:
            own[int(rng.integers(40))] = bad[i % 2]
        texts.append(" ".join(own))
        toxic.append(i % 5 == 0)
    f = [toxicity.features(t) for t in texts]
    model = toxicity.train([x for x, y in zip(f[:600], toxic, strict=False) if y][:60], f[300:600], 0.2)
    scores = toxicity.scores(texts[600:], model)
    assert np.mean((scores >= 0.7) == np.array(toxic[600:])) > 0.95
    assert toxicity.scores([None, ""], model).tolist() == toxicity.scores(["", None], model).tolist()


def test_nothing_to_learn_from(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert 0 < docs.select(toxicity.score(F.col("text"), model).alias("s")).agg(F.max("s")).first()[0] < 0.7
    assert toxicity.fit(empty, labels).buckets.size == 0


# ---- 4: shards


def test_shards_are_even_and_whole(spark, docs, empty):
    rng = np.random.default_rng(2)
    many = spark.createDataFrame([(i, "y" * int(n), str(i % 3), "s") for i, n in enumerate(rng.integers(0, 200, 3000))] + [(9000 + i, "z" * 100, "a", "s") for i in range(1500)], "doc_id long, text string, lang string, source string")
    got = kdshards.slots(kdshards.assign(many, 5)).toPandas()
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(got) == 4500 and len(bytes_) == 5 and bytes_.max() / bytes_.min() < 1.05
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    odd = kdshards.slots(kdshards.assign(docs, 3)).toPandas()
    assert len(odd) == docs.count() and kdshards.slots(kdshards.assign(empty, 3)).count() == 0


def test_copies_of_another_source_share_a_shard(spark):
    rng = np.random.default_rng(4)
    texts = [f"text {i} " + "w " * int(n) for i, n in enumerate(rng.integers(5, 80, 600))]
    rows = [(3 * i + j, t, str(rng.integers(4)), str(rng.integers(5))) for i, t in enumerate(texts) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kdshards.slots(kdshards.assign(docs, 6)).toPandas()
    assert len(got) == len(rows) and got["shard"].nunique() == 6
    assert (got.assign(text=got["doc_id"] // 3).groupby("text")["shard"].nunique() == 1).all()


def test_texts_of_many_spaces_find_a_shard(spark):
    texts = ["a " * 21_475, " " * 300_000, "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in kdshards.metadata(docs).collect()}
    assert [got[i].n_words for i in range(5)] == [50_000, 100_000, 33_333, 0, 0]
    out = kdshards.slots(kdshards.assign(docs, 3)).collect()
    assert sorted(r.doc_id for r in out) == list(range(5)) and sum(r["size"] for r in out) == 42_950 + 300_000 + 3 + 5 * 8


# ---- 5: licenses


def test_places_of_base_phrases(docs, rows, empty):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for r in rows:
        w = pattern.findall((r[1] or "").translate(UPPER))
        at = sorted((i, v) for k, v in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(k.split())] == k.split())
        want.append((r[0], len(w), [i for i, _ in at], sorted({v for _, v in at})))
    got = licenses.scan(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.places, r.base_labels) for r in got))) == sorted(map(str, want))
    assert any("gpl-3" in r.labels and r.score == 1.0 for r in got) and all(set(r.base_labels) <= set(r.labels) for r in got)
    assert licenses.scan(empty).count() == 0


# ---- 6: multiset hashes


def test_multiset_hash_is_order_free_and_incremental(spark):
    df = spark.createDataFrame([("a b\nc d", "c d\na b", "a b", "c d")], "x string, y string, p string, q string")
    v = {n: lthash.vector(lthash.paragraphs(F.col(n))) for n in "xypq"}
    r = df.select(v["x"] == v["y"], lthash.add(v["p"], v["q"]) == v["x"], lthash.subtract(v["x"], v["q"]) == v["p"], lthash.likeness(v["x"], v["y"]), v["x"] == v["p"]).first()
    assert tuple(r) == (True, True, True, 1.0, False)


def test_likeness_of_long_documents(spark):
    rng = np.random.default_rng(13)
    rows = []
    for k in range(40):
        n, share = int(rng.integers(100, 600)), (0.0, 0.25, 0.5, 0.75, 0.95)[k % 5]
        own = [f"p{k}x{j}" for j in range(n)] + ["again and again"] * int(rng.integers(0, 60))
        other = own[: int(share * len(own))] + [f"q{k}x{j}" for j in range(len(own) - int(share * len(own)))]
        x, y = collections.Counter(own), collections.Counter(other)
        rows.append(("\n".join(own), "\n".join(other), (x & y).total() / (x | y).total()))
    df = spark.createDataFrame(rows, "x string, y string, want double")
    df = lthash.with_vector(lthash.with_vector(df, "x", "v"), "y", "w")
    off = [r.got - r.want for r in df.select("want", lthash.likeness(F.col("v"), F.col("w")).alias("got")).collect()]
    assert len(off) == 40 and max(map(abs, off)) < 0.25 and np.mean(np.abs(off)) < 0.08 and abs(np.mean(off)) < 0.05


def test_edited_texts(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y = a[1] or "", b[1] or ""
        h = len(x) // 2
        want.append((a[0], len(x), hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()))
    got = lthash.with_edits(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and lthash.with_edits(empty).count() == 0


# ---- 7: repeats


def test_repeated_strings(docs, rows, empty):
    count = collections.Counter()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        count.update(b[p : p + 400] for p in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert any(w[2] for w in want)
    got = repeats.digest(repeats.removed(docs)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = repeats.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) and repeats.without_repeats(empty).count() == 0


def test_rows_repeated_under_one_id_only(spark):
    rng = np.random.default_rng(9)
    short, long_, once = prose(rng, 400)[:450], prose(rng, 900), prose(rng, 900)
    rows = [(1, short), (1, short), (2, long_), (2, long_), (3, once)]
    got = repeats.digest(repeats.removed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    n = {1: len(short.encode()), 2: len(long_.encode()), 3: len(once.encode())}
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [*[(i, n[i], n[i], 1) for i in (1, 1, 2, 2)], (3, n[3], 0, 0)]


def test_a_name_of_many_places_is_dealt_to_many_tasks(spark):
    sampled = spark.range(60_000).select(F.xxhash64("id").alias("rid"), (F.col("id") % 3).alias("x"), F.when(F.col("id") < 50_000, 7).otherwise(F.col("id") % 6_000).alias("core"))
    rows = sampled.union(sampled.where("core = 9"))
    often = rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = repeats._suspects(rows, often).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    count = collections.Counter(r.core for r in rows.collect())
    want = collections.Counter((r.rid, r.x, r.core) for r in rows.collect() if count[r.core] > 1)
    assert {(r.rid, r.x, r.core): r.copies for r in found} == want and len(found) == len(want)
    assert max(collections.Counter(r.task for r in found).values()) < len(found) / 3


def test_short_passages_leave_with_words(spark):
    """A shared passage of over 50 words is cut out even if it takes under 400 bytes; a shorter one stays."""
    rng = np.random.default_rng(21)
    own = [" ".join(f"{w}{k}" for w in prose(rng, 90).split()) for k in range(4)]
    some = [" ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n)) for n in (60, 45)]
    texts = [f"{own[0]} {some[0]} {own[1]}", f"{own[2]} {some[0]}", f"{some[1]} {own[3]}", f"{some[1]} zz {own[1][::-1]}", None]
    got = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 200, 50).collect()
    kept = {r.doc_id: r.text for r in got}
    assert 200 < len(some[1]) < len(some[0]) < 400
    assert some[0] not in kept[0] and kept[0].split() == (own[0] + " " + own[1]).split() and kept[1].strip() == own[2]
    assert [kept[i] for i in (2, 3, 4)] == texts[2:]


# ---- 8: neighbours


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 8)).astype("float32")
    v[50] = v[51]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] * 8), (None, [1.0] * 8), (480, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, block=32).toPandas()
    x = v.astype(np.float64)
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = [i for i in sorted(range(400), key=lambda i: (-s[i], i)) if i != q][:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == want and np.allclose(own["score"], s[want])
    assert set(got["query_id"]) == set(range(0, 400, 20))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_hilbert_neighbours_are_next_to_each_other():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    order = grid[np.argsort(neighbours.hilbert(grid, 3))]
    assert len(set(neighbours.hilbert(grid, 3))) == 512 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# ---- 9: packing


def test_packing_places_every_id_once(docs, rows, empty):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = collections.Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        assert tokens.ids_of(r[1], *tokens.vocabulary()[:2]).tolist() == ids
        want[(r[0], len(ids) + 1)] += len(ids) + 1
    got = packing.pack(docs).toPandas()
    have = collections.Counter()
    for r in got.itertuples():
        have[(None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens)] += r.length
    assert have == want
    totals = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
        totals.append(int(g["length"].sum()))
    assert max(totals) <= 2048 and sum(t < 2048 for t in totals) == 1
    assert packing.pack(empty).count() == 0


def test_best_neighbour_fills_the_window():
    pieces = [np.array([5, 6, 7, 8] * 5, "<u2"), np.array([20, 21] * 10, "<u2"), np.array([5, 6, 7, 9] * 5, "<u2")]
    idf = np.ones(32, np.float32)
    now = next(packing.fill(pieces, idf, 20.0, 30))
    assert now == [(0, 0, 20), (2, 0, 10)]


# ---- 10: language model


def test_counts_and_base_scores(docs, rows, empty):
    held = toxicity.fold(F.col("doc_id"), 10) == 0
    tok = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in tok if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tok)
    got = maxent.scored(docs, held).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert maxent.scored(empty, held).count() == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(5)
    first = rng.integers(1, 5, 4000).astype(np.uint64) << np.uint64(8)
    codes = np.repeat(first, 2)
    classes = (codes >> np.uint64(8)).astype(np.int64)
    rows = maxent.histories(codes, np.array([0]))
    w = np.zeros((sum(maxent.SIZES) + 1, maxent.CLASSES), np.float32)
    loss = lambda: -maxent.class_logs(w, rows)[np.arange(len(codes)), classes].mean()
    before = loss()
    for _ in range(30):
        maxent.step(w, rows, classes, 0.3)
    assert loss() < 0.5 * before
    assert np.allclose(np.exp(maxent.class_logs(w, rows)).sum(1), 1, atol=1e-4)


def test_gradient_sums_and_own_classes():
    """The cheap forms of a step and of a score give what the plain ones give, also where exp would leave its range."""
    rng = np.random.default_rng(19)
    w = rng.normal(0, 1, (sum(maxent.SIZES) + 1, maxent.CLASSES)).astype(np.float32)
    codes = rng.integers(1, 40, 3000).astype(np.uint64) ** np.uint64(2) << np.uint64(8)
    rows, classes = maxent.histories(codes, np.array([0, 700])), rng.integers(0, maxent.CLASSES, 3000)
    for scale in (1, 300):
        z = (w[rows].astype(float).sum(0) + w[-1]) * scale
        want = z - z.max(1, keepdims=True)
        want -= np.log(np.exp(want).sum(1, keepdims=True))
        assert np.allclose(maxent.own_logs(w * np.float32(scale), rows, classes), want[np.arange(3000), classes], rtol=1e-4, atol=1e-4)
    own = w.astype(float)
    g = np.exp(maxent.class_logs(w, rows).astype(float))
    g[np.arange(3000), classes] -= 1
    for r in rows:
        for b in np.unique(r):
            own[b] -= 0.3 * g[r == b].mean(0)
    own[-1] -= 0.3 * g.mean(0)
    maxent.step(w, rows, classes, 0.3)
    assert np.allclose(w, own, atol=1e-4)


# ---- pipeline


def test_pipeline_stages(spark, docs, empty, run_dir):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int").write.parquet(f"{run_dir}/labels.parquet")
    docs.write.parquet(f"{run_dir}/documents.parquet")
    assert pipeline.run(spark, run_dir).count() > 0
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, run_dir).columns == docs.columns
        assert stage(spark, empty, run_dir).count() == 0

"""Lattice hashing of vectors against a brute-force version."""

import itertools
import math

import numpy as np
import pytest

from tests.compare import compare, duck
from tillworks.llm import catalog, lattice

SCHEMA = "vec_id long, embedding array<{}>, label int, node long, key string, v string, mark string, home string"


def brute(rows, link=0.98):
    """(vec_id, n_links, component_id, kept) of each row, all pairs of a label by their cosine."""

    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) and label is not None else None for _, v, label in rows]
    near = [[] for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= link:
            near[i].append(j)
            near[j].append(i)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((own, len(near[i]), least, own is not None and own == least))
    return sorted(out, key=str)


def answers(df):
    return sorted(map(tuple, df.collect()), key=str)


def apart(rng, x, cosine):
    """A vector of any length at that cosine from ``x``."""
    x = np.asarray(x, float) / np.linalg.norm(x)
    u = rng.standard_normal(len(x))
    u -= (u @ x) * x
    return rng.uniform(0.1, 9) * (cosine * x + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u))


def frame(spark, rows, kind="double", parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "k", "v", "m", "h") for i, v, label in rows], SCHEMA.format(kind)).repartition(parts)


def test_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (300, 8))
    near = lattice.decode(x)
    whole = (near == np.rint(near)).all(1) | (near - 0.5 == np.rint(near - 0.5)).all(1)
    assert whole.all() and (near.sum(1) % 2 == 0).all() and len(lattice.ROOTS) == 240 and ((lattice.ROOTS**2).sum(1) == 2).all()
    own = ((x - near) ** 2).sum(1)
    assert (own[:, None] <= ((x[:, None] - near[:, None] - lattice.ROOTS) ** 2).sum(2) + 1e-9).all() and own.max() <= 1


@pytest.mark.parametrize("kind, block", [("double", 2048), ("float", 2048), ("double", 7)])
def test_links_match_brute_force(spark, kind, block):
    """Pairs around the threshold, chains, a dense group, awkward vectors, several widths, repeated rows and ids."""
    rng = np.random.default_rng(11)
    vectors = [(rng.standard_normal(64), int(rng.integers(0, 3))) for _ in range(150)]
    for x, label in vectors[:60]:
        vectors += [(apart(rng, x, c), label) for c in (0.9805, 0.9795, 0.999)]
    for _ in range(3):  # chains
        x, label = vectors[int(rng.integers(150))]
        for _ in range(8):
            x = apart(rng, x, 0.985)
            vectors.append((x, label))
    centre = rng.standard_normal(64)
    vectors += [(apart(rng, centre, 0.991), 1) for _ in range(120)]  # some pairs link, some do not
    for width in (1, 2, 8, 20, 130):
        x = rng.standard_normal(width)
        vectors += [(x, 0), (2 * x, 0), (rng.standard_normal(width), 0)] + ([(apart(rng, x, 0.99), 0), (apart(rng, x, 0.97), 0)] if width > 1 else [])
    nan, inf = float("nan"), float("inf")
    vectors += [(v, 1) for v in (None, [], [0.0] * 64, [1.0] * 63 + [None], [1.0] * 63 + [nan], [1.0] * 63 + [-inf])]
    vectors += [(vectors[0][0], None), (vectors[0][0], 7), (vectors[1][0], vectors[1][1]), (1e-30 * vectors[2][0], vectors[2][1])]
    ids = rng.permutation(len(vectors)).tolist()
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) if kind == "float" else float(x) for x in v], label) for i, (v, label) in zip(ids, vectors, strict=True)]
    rows += [rows[3], rows[3], (None, rows[4][1], rows[4][2]), (None, None, None), (rows[5][0], rows[9][1], rows[9][2])]
    got = lattice.near_duplicates(frame(spark, rows, kind), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert answers(got) == brute(rows)


def test_pairs_at_the_threshold_are_found(spark):
    """Recall of the index alone on the hardest pairs: a cosine just over the threshold."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        x = rng.standard_normal(64)
        rows += [(2 * i, x, i % 10), (2 * i + 1, apart(rng, x, 0.98001), i % 10)]
    got = lattice.near_duplicates(frame(spark, rows)).where("n_links = 1").count()
    assert got >= 2998


def test_other_shapes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16), 0) for i in range(40)]
    rows += [(100 + i, apart(rng, x, 0.96), 0) for i, x, _ in rows[:20]]
    assert answers(lattice.near_duplicates(frame(spark, rows), link=0.95, tables=6, points=1)) == brute(rows, 0.95)


def test_empty_table(spark):
    assert lattice.near_duplicates(frame(spark, [])).count() == 0


def test_whole_table(spark, folder):
    got, want = compare(duck(folder), catalog.checks()["op13_lattice_near_dedup"], catalog.queries()["op13_lattice_near_dedup"](spark, folder))
    assert got == want

import math

import numpy as np
import pytest

from framewright.llm import op12_hard_negatives as m

SCHEMA = "vec_id bigint, embedding array<float>, label int, vec string, id string, rank string, name string, leaf string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, *"abcde") for i, v, lab in rows], SCHEMA)


def expected(rows, positives=5, negatives=3, low=50, high=95):
    whole = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole[i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for i, lab, v in whole:
        if i % 50:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w, strict=True)), j, other == lab)
            for j, other, w in whole
            if j != i and len(w) == len(v)
        )
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fitting = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fitting, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def random_rows(n, dim, seed, labels=4, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, spread, (8, dim))
    return [
        (i, (middle[rng.integers(8)] + rng.normal(0, spread / 4, dim)).tolist(), int(rng.integers(labels)))
        for i in range(n)
    ]


def test_against_all_products(spark):
    rows = random_rows(700, 12, 1)
    want = expected(rows)
    assert len(want) > 50
    assert found(m.hard_negatives(table(spark, rows), leaf=8, fan=4)) == want


def test_one_leaf_and_query_parts_give_the_same(spark):
    rows = random_rows(400, 6, 2)
    assert found(m.hard_negatives(table(spark, rows))) == expected(rows)
    assert found(m.hard_negatives(table(spark, rows), query_bytes=300, leaf=8, fan=3)) == expected(rows)


def test_tree_of_a_small_sample_covers_all_rows(spark):
    rows = random_rows(900, 5, 3)
    assert found(m.hard_negatives(table(spark, rows), sample=60, leaf=4, fan=3)) == expected(rows)


def test_other_counts_and_limits(spark):
    rows = random_rows(300, 4, 4, labels=2)
    got = m.hard_negatives(table(spark, rows), positives=2, negatives=6, low=10, high=100)
    assert found(got) == expected(rows, 2, 6, 10, 100)


def test_hot_vector_and_ties(spark):
    rows = random_rows(200, 3, 5)
    rows += [(i, [0.25, 0.5, 0.125], i % 3) for i in range(200, 700)]
    rows += [(i, [0.25, 0.25, 0.125], 1) for i in range(700, 800)]
    assert found(m.hard_negatives(table(spark, rows), leaf=8, fan=3)) == expected(rows)


def test_odd_cases(spark):
    rows = [
        (0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (100, [1.0, 2.0], 2), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1),
        (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2),
        (None, [1.0, 2.0], 1), (8, [], 1), (150, [], 2), (9, [1.0, 2.0, 3.0], 1), (200, [-1.0, -2.0], 1),
        (10, [-0.001, 0.0], 2), (11, [0.5, 1.0], None), (12, [0.5, 1.0], 2), (12, [0.7, 1.5], 1), (13, [0.7, 1.4], 3),
        (250, [0.0, 0.0], 4), (251, [0.0, 0.0], 4), (252, [0.0, 0.0], 5), (50, [0.9, 1.7], 2), (14, [1.0, 2.0], -1),
    ]
    assert found(m.hard_negatives(table(spark, rows))) == expected(rows)


def test_ranges_leave_out_subtrees(spark):
    """Clusters far apart: most leaves are ruled out, and none that holds a result."""
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 1, (20, 8))
    sample = np.floor(256 * (middle[rng.integers(20, size=2000)] + rng.normal(0, 0.01, (2000, 8)))).astype(np.int64)
    tree = m.fit(sample, float((sample.astype(float) ** 2).sum(axis=1).max()), fan=6, leaf=30)
    lifted = tree.lift(sample)
    leaves, _ = tree.route(lifted)
    for leaf in set(leaves.tolist()):
        d = tree.distances(lifted[leaves == leaf], tree.path_points(leaf))
        tree.take_ranges(leaf, d.min(axis=0), d.max(axis=0))
    q = sample[:40]
    edge = np.full(40, 1 << 62)
    bounds = m.Bounds(tree, m.Asked(np.arange(40), np.arange(40), np.arange(40), np.arange(40), -edge, edge, q))
    scores, out = q @ sample.T, 0
    best = np.sort(scores, axis=1)[:, -5]
    for leaf in set(leaves.tolist()):
        upper, lower = bounds.leaf(leaf)
        mine = scores[:, leaves == leaf]
        assert (mine <= upper[:, None]).all() and (mine >= lower[:, None]).all()
        out += (upper < best).sum()
    assert out > 0.5 * 40 * len(set(leaves.tolist()))


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(1, [1.0], 1)], [(0, None, None)]])
def test_too_few(spark, rows):
    assert m.hard_negatives(table(spark, rows)).collect() == []

import math

import numpy as np
import pytest

from framewright.llm import op9_vector_search as m

SCHEMA = "vec_id bigint, embedding array<float>, vec string, id string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def expected(rows, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for i, v in whole:
        if i % 50 == 0:
            hits = sorted(
                (-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v)
            )
            out += [(i, r, j, -s) for r, (s, j) in enumerate(hits[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def random_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.3, dim).tolist()) for i in range(n)]


def test_against_all_products(spark):
    rows = random_rows(400, 16, 1) + [(i, [0.25] * 16) for i in range(400, 520)]
    assert found(m.top_k(table(spark, rows))) == expected(rows)


def test_query_parts_give_the_same(spark):
    rows = random_rows(600, 8, 2)
    assert found(m.top_k(table(spark, rows), query_bytes=200)) == expected(rows)


def test_odd_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]),
        (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (None, [1.0, 2.0]), (8, []), (150, []), (9, [1.0, 2.0, 3.0]), (200, [-1.0, -2.0]), (10, [-0.001, 0.0]),
        (250, None),
    ]
    assert found(m.top_k(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(1, [1.0])]])
def test_too_few(spark, rows):
    assert m.top_k(table(spark, rows)).collect() == []

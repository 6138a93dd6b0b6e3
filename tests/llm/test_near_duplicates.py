import random

import numpy as np
import pytest
from corpus_cases import empty, frame, odd_rows, prose

from framewright.llm import op6_near_duplicates as m
from framewright.llm.components import components
from framewright.llm.shingles import shingle_set, word_hashes


def expected(rows, k):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return sorted(
        ((d, len(sets[i]), ids[top(i)] if d is not None else None, d is None or d == ids[top(i)]) for i, (d, *_) in enumerate(rows)),
        key=str,
    )


def found(spark, rows, k=2):
    return sorted(map(tuple, m.near_duplicates(frame(spark, rows), k).collect()), key=str)


def near_group(seed: int, copies: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    words = prose(seed, 120).split()
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, k):
    texts = [t for s in range(4) for t in near_group(s, 12, 1 + s * 2)] + [prose(500 + i, 80) for i in range(15)]
    texts += [texts[0].upper(), texts[3], texts[3]]
    random.Random(5).shuffle(texts)
    rows = [(1000 - i, t, "en", "a", 0) for i, t in enumerate(texts)]
    assert found(spark, rows, k) == expected(rows, k)


def test_a_chain_is_one_group(spark):
    """Neighbours are similar, the ends are not; the middle ones link them."""
    words = prose(1, 100).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words), "en", "a", 0))
        for j in range(3):
            words[(i * 3 + j) % 100] = f"step{i}x{j}"
    assert found(spark, rows) == expected(rows, 2)


def test_odd_cases(spark):
    assert found(spark, odd_rows()) == expected(odd_rows(), 2)


def test_empty_table(spark):
    assert m.near_duplicates(empty(spark)).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    x, y = m.registers(a), m.registers(b)
    assert (m.registers(np.union1d(a, b)) == np.maximum(x, y)).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    plus, minus = (np.array([(f(x[: m.JUDGED], y[: m.JUDGED])).sum()]) for f in (np.greater, np.less))
    got = m.likely(plus, minus, np.array([len(a)]), np.array([len(b)]))
    assert abs(got[0] - true) < 0.12


def test_shingles_are_words_split_at_six_blanks():
    texts = [b"a\x0bb\xc2\xa0c  d", b"", b" x ", b"a b a b"]
    words = word_hashes(texts)
    assert [len(w) for w in words] == [3, 0, 1, 4]
    assert [len(shingle_set(w, 2)) for w in words] == [2, 0, 1, 2]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 80), (7, 7)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert dict(map(tuple, found)) == {**{i: 0 for i in range(51)}, 60: 60, 80: 60, 100: 60}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus_cases import empty, frame, odd_rows, prose

from framewright.llm import op5_repeats as m


def expected(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = m.LENGTH
    c = Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        edge = np.zeros(len(t) + 1, dtype=int)
        for p in range(len(t) - n + 1):
            if c[t[p : p + n]] > 1:
                edge[p] += 1
                edge[p + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = m.remove_repeats(frame(spark, rows), digests=True)
    return sorted(map(tuple, df.collect()), key=str)


def repetitive(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    passages = [prose(1000 + i, 70) for i in range(4)]
    rows = []
    for i in range(25):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += [prose(rng.randrange(10**6), rng.randrange(3, 30)), p[a : a + rng.randrange(380, 480)]]
        rows.append((i, rng.choice(["", " ", "é"]).join(parts), "en", "a", 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_strings(spark, seed):
    rows = repetitive(seed)
    rows += [(100, "a" * 1500, "", "", 0), (101, "a" * 401, "", "", 0), (102, "ab" * 250, "", "", 0)]
    rows += [(103, "b" * 400, "", "", 0), (104, "é" * 199 + "zz", "", "", 0)]
    assert found(spark, rows) == expected(rows)


def test_odd_cases(spark):
    rows = odd_rows()
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert m.remove_repeats(empty(spark)).collect() == []


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    """Segments of one long text are judged like the whole: here in this process."""
    rows = [*repetitive(7), (50, " ".join(t for _, t, *_ in repetitive(8)), "", "", 0)]
    texts = [t.encode() for _, t, *_ in rows]

    def starts(size):
        monkeypatch.setattr(m, "CHUNK_BYTES", size)
        seen = []
        for piece, names in m.pieces(texts):
            begins = np.array([b for *_, b in names])
            for low, high in zip(piece.low, piece.high, strict=True):
                number, at, begin = names[int(np.searchsorted(begins, low, side="right")) - 1]
                seen += [(number, at + p - begin) for p in range(low, high + 1)]
            for p in piece.gaps.tolist():
                number, at, begin = names[int(np.searchsorted(begins, p, side="right")) - 1]
                seen.append((number, at + p - begin))
        return sorted(seen)

    every = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - m.LENGTH + 1)]
    assert starts(1 << 20) == every
    assert starts(700) == every


def test_groups_cut_at_a_border_stay_exact():
    y = np.array([1, 1, 2, 3, 3, 3])
    x = np.array([5, 5, 6, 7, 7, 8])
    many = np.zeros(6, dtype=bool)
    assert m.judge(y, x, many, False, False).tolist() == [1, 1, 0, 3, 1, 2]
    assert m.judge(y, x, many, True, True).tolist() == [3, 1, 0, 3, 1, 2]
    assert m.judge(y[2:3], x[2:3], many[2:3], True, False).tolist() == [2]


def test_a_string_travels_with_its_place_in_two_numbers():
    t = np.random.default_rng(1).integers(0, 1 << 64, 300, dtype=np.uint64)
    many = t % np.uint64(3) == 0
    for chunk in (0, 5, (7 << 33) + 12, (((1 << 20) - 1) << 33) + (1 << 19) - 1):
        head, place, mark = m.place_of(m.with_place(t, chunk, many))
        assert (head == t >> np.uint64(40)).all() and (place == chunk).all() and (mark == many).all()
    for chunk in (1 << 53, 1 << 19):
        with pytest.raises(ValueError, match="too many chunks"):
            m.with_place(t, chunk, many)

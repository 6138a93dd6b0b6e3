import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_cases import empty, frame, odd_rows, prose

from framewright.llm import op2_class_ngrams as m


def base_scores(rows):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    c = Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
    n, v = sum(c.values()), len(c)
    return sorted(
        (
            (i, h, len(t), sum(c[x] > 0 for x in t), n,
             round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6))
            for (i, *_), t, h in zip(rows, tokens, held, strict=True)
        ),
        key=str,
    )


@pytest.mark.parametrize("known", [5, 10_000])
def test_base_score_by_brute_force(spark, known):
    rows = odd_rows()
    found = m.score(frame(spark, rows), clustered=4, classes=2, known=known).collect()
    assert (
        sorted(
            ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found),
            key=str,
        )
        == base_scores(rows)
    )
    assert all(r.score <= 0 for r in found)


def test_split_of_the_counts_does_not_change_scores(spark):
    rows = [(i, prose(i, 60), "en", "a", 0) for i in range(40)]
    few = {r.doc_id: r.score for r in m.score(frame(spark, rows), clustered=8, classes=3, known=300).collect()}
    all_ = {r.doc_id: r.score for r in m.score(frame(spark, rows), clustered=8, classes=3, known=9_999).collect()}
    assert few.keys() == all_.keys()
    assert all(abs(few[k] - all_[k]) < 1e-9 * abs(all_[k]) + 1e-9 for k in few)


def test_empty_table(spark):
    assert m.score(empty(spark)).collect() == []


def test_best_class_agrees_with_recounted_likelihood():
    rng = np.random.default_rng(3)
    size, classes = 9, 3
    counts = rng.integers(0, 9, (size + 2, size + 2)).astype(float)
    of = np.append(np.arange(size) % classes, [classes, classes + 1])

    def table(cls):
        t = np.zeros((classes + 2, classes + 2))
        np.add.at(t, (cls[:, None], cls[None, :]), counts)
        return t

    for word in range(size):
        values = []
        for c in range(classes):
            moved = of.copy()
            moved[word] = c
            values.append(m.likelihood(table(moved)))
        after = np.array([counts[word, [j for j in range(size + 2) if of[j] == c and j != word]].sum() for c in range(classes + 2)])
        before = np.array([counts[[j for j in range(size + 2) if of[j] == c and j != word], word].sum() for c in range(classes + 2)])
        got = m.best_class(table(of), after, before, counts[word, word], int(of[word]), classes)
        assert values[got] >= max(values) - 1e-6


def test_classes_beat_single_words_on_class_structure(spark):
    """Texts alternate between two word groups; classes learn it, held-out texts profit."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        a, b = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
        rows.append((i, " ".join(f"a{x} b{y}" for x, y in zip(a, b, strict=True)), "en", "s", 0))
    found = [r for r in m.score(frame(spark, rows), clustered=60, classes=2).collect() if r.held_out]
    assert found and all(r.score > r.base_score for r in found)


def test_words_outside_the_core_learn_their_class_too(spark):
    """As above, with twenty of sixty words in the core: nearly the whole bit of the alternation is gained."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
        rows.append((i, " ".join(f"a{x} b{y}" for x, y in zip(a, b, strict=True)), "en", "s", 0))
    for known in (10_000, 0):
        found = m.score(frame(spark, rows), clustered=20, classes=2, known=known).filter("held_out").collect()
        gain = sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found)
        assert gain > 0.25


def test_placing_agrees_with_best_class():
    rng = np.random.default_rng(5)
    size, classes = 40, 4
    width = classes + 2
    counts = rng.poisson(0.4, (size + 2, size + 2)).astype(float)
    of = np.append(rng.integers(0, classes + 1, size), [classes, classes + 1])
    table = np.zeros((width, width))
    np.add.at(table, (of[:, None], of[None, :]), counts)
    word, cell, n, expected = [], [], [], []
    free = np.flatnonzero(of[:size] == classes)
    for at, w in enumerate(free):
        profile = np.zeros(2 * width + 1)
        for j in range(size + 2):
            if j != w:
                profile[of[j]] += counts[w, j]
                profile[width + of[j]] += counts[j, w]
        profile[-1] = counts[w, w]
        cells = np.flatnonzero(profile)
        word += [at] * len(cells)
        cell += cells.tolist()
        n += profile[cells].tolist()
        values = []
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            t = np.zeros((width, width))
            np.add.at(t, (moved[:, None], moved[None, :]), counts)
            values.append(m.likelihood(t))
        expected.append(values)
    got = m.place(table, np.array(word), np.array(cell), np.array(n), len(free), classes)
    assert all(values[g] >= max(values) - 1e-6 for g, values in zip(got, expected, strict=True))


def test_every_training_word_has_a_class_and_its_count(spark):
    rows = [(i, prose(i, 30) + " same same same", "en", "a", 0) for i in range(20)]
    model, more, _ = m.train(frame(spark, rows), clustered=8, classes=3, known=0)
    seen = Counter(w for r in rows for w in r[1].encode().split())
    found = {bytes(r["word"]): r["n"] for r in more.collect()}
    assert {**found, **{w: seen[w] for w in model.number}} == dict(seen)
    assert len(found) == len(seen) - 8
    assert {r["class"] for r in more.collect()} <= {0, 1, 2}


def test_without_training_rows_scores_are_finite(spark):
    rows = [(i, "x y z", "en", "a", 0) for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    found = m.score(frame(spark, rows)).collect()
    assert found and all(math.isfinite(r.score) and r.score <= 0 and r.n_known == 0 for r in found)


def test_words_are_those_of_python():
    texts = [None, "", " ", "Ab  \tc\n", "\x0bÄB é\x85x\x1cY\x0c", "a\u2003b a", " lead", "İ ﬀ A\x00B", "a a a"]
    t = m.tokens_of(pa.array(texts, pa.string()))
    flat = [t.distinct[i].as_py() for i in t.word.tolist()]
    cut = [flat[a:b] for a, b in zip(t.edges[:-1], t.edges[1:], strict=True)]
    assert cut == [(x or "").encode().lower().split() for x in texts]
    line = np.full(t.line, -1)
    line[t.spot] = t.text
    assert line.tolist() == [j for i, c in enumerate(cut) for j in (-1, *[i] * len(c), -1)]


def test_rows_are_held_by_their_bytes():
    sizes = [5, 900, 0, 70, 2_000, 1, 1, 300, 400, 0]
    batch = pa.record_batch([pa.array(["x" * n for n in sizes]), pa.array(range(len(sizes)))], ["text", "i"])
    for most in (1, 500, 10**6):
        runs = list(m.held_rows(iter([batch[:3], batch[:0], batch[3:]]), 0, most))
        assert [i for r in runs for i in r.column(1).to_pylist()] == list(range(len(sizes)))
        held = [[len(x) + 16 for x in r.column(0).to_pylist()] for r in runs]
        assert all(sum(h) >= most for h in held[:-1]) and all(sum(h[:-1]) < most for h in held)
    assert list(m.held_rows(iter([batch[:0]]), 0, 500)) == []


def test_words_of_a_slice_are_counted_together(monkeypatch):
    """Counts of a run of texts are one batch with each word once, whatever the batches that come in."""
    texts = pa.record_batch([pa.array(["a b A", "b c", None, "a"])], ["text"])
    batches = [texts[:1], texts[1:2], texts[2:]]
    (found,) = m._count_words(iter(batches))
    assert dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)) == {b"a": 3, b"b": 2, b"c": 1}
    monkeypatch.setattr(m, "HELD_BYTES", 1)
    assert [r["n"].to_pylist() for r in m._count_words(iter(batches))] == [[2, 1], [1, 1], [], [1]]

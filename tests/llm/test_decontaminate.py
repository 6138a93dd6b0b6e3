import random

import numpy as np
from corpus_cases import empty, frame, odd_rows, prose

from framewright.llm import op3_decontaminate as m


def edits_inside(item: bytes, text: bytes) -> int:
    """Least edits of the item against any stretch of the text."""
    row = np.zeros(len(text) + 1, dtype=int)
    for i, a in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, b in enumerate(text, 1):
            new[j] = min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def edited(text: str, n: int, rng: random.Random) -> str:
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "#"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "#")
    return "".join(out)


def test_against_full_alignment():
    rng = random.Random(4)
    items = [prose(s, 14) for s in range(6)]
    index = m.build_index(list(enumerate(items)))
    for trial in range(60):
        item = rng.randrange(6)
        text = prose(100 + trial, 8) + " " + edited(items[item], rng.randrange(0, 9), rng) + " " + prose(200 + trial, 8)
        found = {h[1]: h for h in m.scan(index, [m.fold(text)])}
        for i in range(6):
            true = edits_inside(m.fold(items[i]), m.fold(text))
            assert (i in found) == (true <= index.edits[i]), (trial, i, true)
            if i in found:
                assert found[i][4] == true
                assert edits_inside(m.fold(items[i]), m.fold(text)[found[i][2] : found[i][3]]) == true


def bench(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, doc_id string")


def test_odd_cases(spark):
    items = [(1, prose(10, 20)), (2, None), (3, ""), (4, "short"), (None, prose(8, 5)), (1, prose(10, 20))]
    rows = [*odd_rows(), (11, "Say: " + prose(10, 20).upper().replace(" ", "\n") + " end", "en", "a", 0)]
    found = m.find(frame(spark, rows), bench(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.edits) for r in found if r.doc_id == 11) == [(11, 1, 5, 0)] * 2
    # The text of document 10 begins with the item, which comes twice.
    assert [(r.item_id, r.start) for r in found if r.doc_id == 10] == [(1, 0)] * 2
    assert {r.doc_id for r in found} <= {8, 10, 11}
    kept = m.remove_leaks(frame(spark, rows), bench(spark, items))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == len(rows) - len({r.doc_id for r in found})


def test_empty_tables(spark):
    assert m.find(empty(spark), bench(spark, [(1, prose(1, 20))])).collect() == []
    assert m.find(frame(spark, odd_rows()), bench(spark, [])).collect() == []
    assert m.remove_leaks(frame(spark, odd_rows()), bench(spark, [])).count() == len(odd_rows())


def test_blocks_of_the_benchmark_find_the_same(spark):
    items = [(i, prose(i, 15)) for i in range(30)]
    docs = frame(spark, [(i, prose(900 + i, 30) + " " + prose(i, 15), "en", "a", 0) for i in range(30)])
    one = sorted(map(tuple, m.find(docs, bench(spark, items)).collect()))
    assert m._block_of(bench(spark, items), 500)[1] > 3
    assert sorted(map(tuple, m.find(docs, bench(spark, items), block_bytes=500).collect())) == one
    kept = [m.remove_leaks(docs, bench(spark, items), block_bytes=n).count() for n in (500, m.BLOCK_BYTES)]
    assert len(one) == 30 and kept == [0, 0]


def test_one_index_is_held_at_a_time(spark, monkeypatch):
    """Each block's index is dropped before the next is built."""
    held, most = [], []
    index = m._index

    def watched(*args):
        held.append(index(*args))
        most.append(sum(not getattr(h, "_gone", False) for h in held))
        drop = held[-1].destroy
        held[-1].destroy = lambda: (setattr(held[len(most) - 1], "_gone", True), drop())
        return held[-1]

    monkeypatch.setattr(m, "_index", watched)
    docs = frame(spark, [(i, prose(i, 20), "en", "a", 0) for i in range(9)])
    m.find(docs, bench(spark, [(i, prose(i, 15)) for i in range(30)]), block_bytes=700).collect()
    assert len(most) > 3 and max(most) == 1

import numpy as np
from corpus_cases import empty, frame, odd_rows, prose

from framewright.llm import op10_mixing as m


def test_targets():
    aims = m.targets([("b", 100), (None, 100), ("a", 10), ("c", 100)])
    assert [a[0] for a in aims] == ["a", "b", "c", None]
    assert [a[1] for a in aims] == [10, 100, 100, 100]
    # Weights 3, 1, 2, 3 of 465: a stops at 20; the rest share 445 by 1, 2, 3, and null stops at 200.
    assert [round(a[2], 6) for a in aims] == [20, round(245 / 3, 6), round(245 * 2 / 3, 6), 200]
    assert m.targets([]) == [] and m.targets([("a", 0)]) == [("a", 0, 0.0)]


def test_quotas_are_exact():
    counts = np.array([1000, 0, 7, 333])
    got = m._quotas(counts, 16, np.random.default_rng(1))
    assert got.shape == (4, 16) and (got.sum(axis=1) == counts).all()
    assert got.sum(axis=0).max() - got.sum(axis=0).min() <= 4


def many(n=900):
    return [(i, prose(i, 5 + i % 70), "en", ["hot", "a", None][min(i % 6, 2) if i % 6 < 3 else 0], 0) for i in range(n)]


def test_sources_meet_their_targets_on_every_level(spark):
    rows = many()
    for settings in ({}, {"fanout": 4, "last_words": 300}):
        plan = m.plan_mix(frame(spark, rows), **settings).collect()
        assert len(plan) == len(rows)
        taken = {}
        for r in plan:
            assert 0 <= r.copies <= 2 and len(r.shards) == r.copies
            taken.setdefault(r.source, [0, r.target])[0] += r.copies * r.size
        for got, target in taken.values():
            assert abs(got - target) <= 80


def test_reruns_agree_and_mix_follows_the_plan(spark):
    docs = frame(spark, many(200))
    one, two = (sorted(map(str, m.plan_mix(docs).collect())) for _ in range(2))
    assert one == two
    mixed = m.mix(docs).collect()
    copies = {r.doc_id: r.copies for r in m.plan_mix(docs).collect()}
    assert len(mixed) == sum(copies.values())
    assert {r.doc_id for r in mixed} == {i for i, c in copies.items() if c}


def test_odd_cases(spark):
    docs = frame(spark, odd_rows())
    plan = m.plan_mix(docs).collect()
    assert sum(r.rows for r in plan) == len(odd_rows())
    assert {r.doc_id: r.rows for r in plan}[5] == 2
    assert all(r.size == 0 for r in plan if r.doc_id in (1, 2, 3))
    mixed = m.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_place"]
    assert m.plan_mix(empty(spark)).collect() == []
    assert m.mix(empty(spark)).count() == 0


def test_quota_is_filled_behind_a_long_document(spark):
    """One document of 10,000 words and 500 of 10: whatever the border meets, nothing that fits is left."""
    rows = [(0, "w " * 10_000, "en", "a", 0)] + [(i, "w " * 10, "en", "a", 0) for i in range(1, 501)]
    for seed in (3,):
        plan = m.plan_mix(frame(spark, rows), seed, fanout=4, last_words=300, share=0.66).collect()
        assert len(plan) == len(rows)
        taken = sum(r.copies * r.size for r in plan)
        left = plan[0].target - taken
        assert 0 <= left and all(r.size > left for r in plan if r.copies == 0)


def test_best_fit_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(200):
        words = rng.integers(0, 30, rng.integers(0, 9)).tolist()
        left = int(rng.integers(0, 90))
        taken = m.best_fit(words, left)
        sums = [sum(w for i, w in enumerate(words) if c >> i & 1) for c in range(1 << len(words))]
        assert sum(w for w, t in zip(words, taken, strict=True) if t) == max(s for s in sums if s <= left)


def test_small_sources_meet_their_targets(spark):
    """Few documents of very different sizes: the choice at the border is the best there is."""
    rows = [(i, "w " * n, "en", "a", 0) for i, n in enumerate([1066, 900, 700, 333, 200, 120, 77, 13])]
    rows += [(100 + i, "w " * 50, "en", "b", 0) for i in range(60)]
    for seed in range(3):
        plan = m.plan_mix(frame(spark, rows), seed).collect()
        taken = sum(r.copies * r.size for r in plan if r.source == "a")
        target = next(r.target for r in plan if r.source == "a")
        sizes = [r.size for r in plan if r.source == "a"]
        whole = int(target // sum(sizes))
        sums = {sum(n for i, n in enumerate(sizes) if c >> i & 1) + whole * sum(sizes) for c in range(1 << len(sizes))}
        assert taken == max(s for s in sums if s <= target)


def test_shards_grow_with_the_words(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_WORDS", 100)
    mixed = m.mix(frame(spark, many(400)), last_words=50).groupBy("mix_shard").agg({"size": "count"}).count()
    assert mixed > m.SHARDS

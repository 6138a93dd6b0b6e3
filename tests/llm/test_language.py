import zlib

import numpy as np
from corpus_cases import empty, frame, odd_rows

from framewright.llm import op4_language as m


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = m.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert code.shape[0] == n and min(apart) >= (1 if n == 2 else 2)
    assert m.codewords(4).shape == (4, 7)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = m.identify(docs).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_labels_are_no_input_of_a_prediction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = m.train(docs.filter(~m.held_out()))
    blind = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source")
    one = {r.doc_id: r.lang_pred for r in m.predict(docs, model).collect()}
    two = {r.doc_id: r.lang_pred for r in m.predict(blind, model).collect()}
    assert one == two


def test_odd_cases(spark):
    docs = frame(spark, odd_rows())
    found = m.identify(docs).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr") and 0 < r.score <= 1
    kept = m.keep_known(docs)
    assert kept.columns == docs.columns
    assert not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()}


def test_no_or_one_language(spark):
    assert m.identify(empty(spark)).collect() == []
    none = frame(spark, [(i, "some text", None, "a", 0) for i in range(4)])
    assert {(r.lang_pred, r.score) for r in m.identify(none).collect()} == {("und", 0.0)}
    one = frame(spark, [(i, "some text", "en", "a", 0) for i in range(9)])
    assert {(r.lang_pred, r.score) for r in m.identify(one).collect()} == {("en", 1.0)}


def test_rows_without_ids_are_sampled_like_others(spark):
    """A third of the rows has no id: the bound of the sample holds, and none of them dominates it."""
    rows = [(None if i % 3 == 0 else i, f"text number {i} of many", "en" if i % 2 else "de", "a", 0) for i in range(6000)]
    docs = frame(spark, rows)
    got = []
    reliable = m.reliable

    def keep(df):
        got.append(reliable(df))
        return got[-1]

    m.reliable = keep
    try:
        m.train(docs, per_language=300)
    finally:
        m.reliable = reliable
    counts = {r["lang"]: r["count"] for r in got[0].groupBy("lang").count().collect()}
    assert set(counts) == {"en", "de"} and all(200 < n < 400 for n in counts.values())

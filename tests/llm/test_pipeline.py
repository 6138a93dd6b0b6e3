import json

import corpus_pipeline
import __spark_entry__ as entry
from corpus_cases import frame, odd_rows

from framewright.session import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_over_the_smoke_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == COLUMNS
        counts.append(docs.count())
    assert counts[0] == counts[1] > counts[2] > counts[3]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = [r.text for r in docs.select("text").collect()]
    assert not [i for i in items if any(i in t for t in texts)]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = out.orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = frame(spark, odd_rows(), clash=False)
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 5, 7, 8, 9, 10]


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 11 and {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert json.dumps(entry.oracle_sql())

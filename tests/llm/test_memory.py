"""What the operators of the pipeline hold in a task, and start on the executors."""

import tracemalloc

import pyarrow as pa
import public_tokenizers
import pytest
from corpus_cases import frame, prose

from framewright.llm import op3_decontaminate, op4_language, op6_near_duplicates, op8_token_files
from framewright.llm.common import driver_table
from framewright.session import shared_path

SCHEMA = pa.schema([("l", pa.string()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])


class Held:
    def __init__(self, value):
        self.value = value


@pytest.fixture(scope="module")
def batch():
    texts = [prose(i, 700) for i in range(40)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(2_000)), "text": [texts[i % 40] for i in range(2_000)]})


def peak(run, batch) -> int:
    for _ in run(iter([batch.slice(0, 100)])):
        pass
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_task_does_not_hold_the_texts_of_a_batch(batch):
    index = op3_decontaminate.build_index([(1, prose(7, 30)), (2, "a text that is nowhere else")])
    size = batch.column(1).nbytes
    assert size > 8e6
    for run in (
        op6_near_duplicates._sketch(5), op6_near_duplicates._sets(5), op3_decontaminate._clean(Held(index), 1)
    ):
        assert peak(run, batch) < size


def test_cleaned_slices_are_the_batch_without_its_leaks(batch):
    index = op3_decontaminate.build_index([(1, prose(7, 30))])
    got = pa.Table.from_batches(op3_decontaminate._clean(Held(index), 1)(iter([batch])))
    assert got.column("doc_id").to_pylist() == [i for i in range(2_000) if i % 40 != 7]
    assert got.schema == batch.schema


def test_predictions_are_sent_in_parts(spark, monkeypatch):
    docs = frame(spark, [(i, prose(i % 9, 12) if i % 4 else None, "en", "a", i) for i in range(50)], clash=False)
    model = op4_language.train(docs)
    whole = sorted(map(tuple, op4_language.predict(docs, model).collect()))
    monkeypatch.setattr(op4_language, "_ROWS", 7)
    assert sorted(map(tuple, op4_language.predict(docs, model).collect())) == whole
    assert len(whole) == 50


def test_rows_of_the_driver_start_no_python(spark):
    rows = [(None, 1, [1, 2]), ("a", None, []), ("b", 3, None)]
    for some in (rows, []):
        made = driver_table(spark, some, SCHEMA)
        assert [(r.l, r.n, r.ends) for r in made.collect()] == some
        assert made.schema.simpleString() == "struct<l:string,n:bigint,ends:array<bigint>>"
        assert "RDD" not in made._jdf.queryExecution().toString()


def test_slices_of_any_size_give_the_same_files(spark):
    docs = frame(spark, [(i, prose(i, 40) + "  x" * (i % 3), "en", "a", 1) for i in range(30)])
    found, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size, rows in ((1, None), (500, 3), (4 << 20, None)):
        path = shared_path(spark, "tokens")
        op8_token_files.write_tokens(
            docs, path, public_tokenizers.path("byte_bpe_50k.json"), kept_words=0, slice_bytes=size, batch_rows=rows
        )
        found.append(sorted(map(tuple, op8_token_files.token_digests(op8_token_files.read_tokens(spark, path)).collect())))
    assert found[0] == found[1] == found[2]
    assert spark.conf.get(key) == before


def test_token_files_are_made_of_batches_of_so_many_rows(spark, monkeypatch, tmp_path):
    seen = tmp_path / "rows"

    def encode(*_):
        def run(batches):
            for batch in batches:
                with seen.open("a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield pa.RecordBatch.from_pylist([], schema)

        return run

    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("part_offset", pa.int64()), ("n_tokens", pa.int64()),
         ("ids", pa.list_(pa.int32()))]
    )
    monkeypatch.setattr(op8_token_files, "_encode", encode)
    docs = frame(spark, [(i, prose(i, 4), "en", "a", 1) for i in range(200)])
    op8_token_files.write_tokens(docs, shared_path(spark, "tokens"), "", batch_rows=3)
    counts = list(map(int, seen.read_text().split()))
    assert sum(counts) == 200 and max(counts) == 3

"""JSON arrays and CSV files cut inside a file, at places that fall anywhere."""

import csv
import io
import json
import random
from contextlib import contextmanager

import pytest
from helpers import rows

from framewright.functions.columns import col
from framewright.sources.delimited import read_csv
from framewright.sources.pieces import read_pieces
from framewright.sources.records import cut_records, read_json

TEXTS = ["", "plain", 'quo"te', "br}ace", "[{,]}", "back\\slash", "\\", '\\"}', "line\nend", "é {😀}", '"', "}", "tab\t", "a,b"]


@contextmanager
def splits_of(spark, size):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode() if isinstance(text, str) else text)
    return str(tmp_path / name)


def objects(n, seed):
    rng = random.Random(seed)

    def value(depth=0):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return rng.choice(TEXTS)
        if kind == 2:
            return rng.choice([None, True, 1.5, 7])
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {rng.choice(TEXTS[1:]) + str(i): value(depth + 1) for i in range(rng.randrange(3))}

    return [{"id": i, "t": rng.choice(TEXTS), "v": json.dumps(value())} | ({"n": value()} if i % 2 else {}) for i in range(n)]


@pytest.mark.parametrize("size", [300, 1000])
@pytest.mark.parametrize("indent", [None, 2])
def test_cut_arrays(spark, tmp_path, size, indent):
    want = objects(25, size)
    path = put(tmp_path, "a.json", json.dumps(want, indent=indent, ensure_ascii=False))
    with splits_of(spark, size):
        assert read_pieces(spark, path, "}").select("_block").distinct().count() > 1
        got = cut_records(spark, path).orderBy("_record").collect()
    assert [json.loads(r["value"]) for r in got] == want


def test_read_like_whole_files(spark, tmp_path):
    flat = [{k: r[k] for k in ("v", "t", "id")} for r in objects(80, 1)]
    for i, some in enumerate([flat[:30], flat[30:], []]):
        put(tmp_path, f"{i}.json", json.dumps(some))
    put(tmp_path, "blank.json", " \n")
    with splits_of(spark, 500):
        cut = read_json(spark, str(tmp_path), "records")
    whole = read_json(spark, str(tmp_path), "records")
    assert cut.dtypes == whole.dtypes == [("v", "string"), ("t", "string"), ("id", "bigint")]
    assert rows(cut, "id") == rows(whole, "id") == [(r["v"], r["t"], r["id"]) for r in flat]


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    path = put(tmp_path, "a.json", json.dumps([{"id": i, "t": "x" * 50} for i in range(4000)]))
    with splits_of(spark, 20_000):
        pieces = read_pieces(spark, path, "}")
        assert pieces.select("_block").distinct().count() > 10
        assert read_json(spark, path).agg({"id": "sum"}).first()[0] == 3999 * 2000


def test_no_sum_needs_a_whole_split(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from framewright.sources import pieces as cut

    monkeypatch.setattr(cut, "RUN_BITS", 3)
    monkeypatch.setattr(cut, "TASK_BYTES", 10_000)
    want = objects(60, 9)
    path = put(tmp_path, "a.json", json.dumps(want))
    pieces = read_pieces(spark, path, "}")
    assert pieces.select("_block").distinct().count() == 1
    assert pieces.groupBy("_block", "_run").count().agg(F.max("count")).first()[0] == 8
    tasks = cut.tasks_for(pieces)
    summed = cut.running(pieces, F.octet_length("_text"), "_before", tasks)
    assert summed.rdd.getNumPartitions() == tasks > 3
    before = 0
    for row in summed.orderBy("_row").collect():
        assert row["_before"] == before
        before += len(row["_text"].encode())
    got = cut_records(spark, path).orderBy("_record").collect()
    assert [json.loads(r["value"]) for r in got] == want


def test_folder_columns_stay(spark, tmp_path):
    for day in ("1", "2"):
        (tmp_path / f"day={day}").mkdir()
        put(tmp_path / f"day={day}", "a.json", json.dumps([{"id": int(day) * 10 + i} for i in range(9)]))
    cut = read_json(spark, str(tmp_path), "records", cut_above=0)
    assert rows(cut, "id") == [(d * 10 + i, d) for d in (1, 2) for i in range(9)]


def test_objects_after_each_other_and_byte_order_mark(spark, tmp_path):
    text = '﻿ {"a": {"b": "}"}}\n\n{"a": null} '
    with splits_of(spark, 20):
        got = cut_records(spark, put(tmp_path, "a.json", text)).orderBy("_record").collect()
        assert [json.loads(r["value"]) for r in got] == [{"a": {"b": "}"}}, {"a": None}]
        closed = put(tmp_path, "b.json", '﻿[{"a": 1}]')
        assert [r["value"] for r in cut_records(spark, closed).collect()] == ['{"a": 1}']


@pytest.mark.parametrize(
    "text",
    [
        '[{"a": 1}, {"a": 2}', '[{"a": 1}, {"a": 2', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', '{"a": 1}, {"a": 2}',
        '[{"a": 1}], [{"a": 2}]', '[1, {"a": 2}]', '[{"a": 2}, 1]', '[{"a": "x}]', '[{"a": 1}}]', '[{"a": [1}]}]',
        '[{"a" 1}]', "{", "[", '[{"a": 1}', '{"a": "\x1e"}',
    ],
)
def test_malformed_raises(spark, tmp_path, text):
    path = put(tmp_path, "a.json", text)
    with pytest.raises(Exception, match="(?i)malformed|invalid|parse"):
        read_json(spark, path, "records", cut_above=0).collect()


def test_short_and_packed_files_are_read_whole(spark, tmp_path):
    import gzip

    text = json.dumps([{"a": i} for i in range(50)])
    short = put(tmp_path, "a.json", text)
    assert read_json(spark, short).inputFiles() == [f"file://{short}"]
    packed = put(tmp_path, "b.json.gz", gzip.compress(text.encode()))
    with splits_of(spark, 20):
        assert rows(read_json(spark, packed, "records"), "a") == [(i,) for i in range(50)]


def table(n, seed):
    rng = random.Random(seed)
    cells = ["", "x", "two words", 'a "quoted" one', "line\nfeed", "crlf\r\nhere", "\n\n", ",", '"', "é\n", "last"]
    return [[str(i), *(rng.choice(cells) for _ in range(3))] for i in range(n)]


def as_csv(body, end="\n", header=("id", "a", "b", "c")):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([header, *body])
    return out.getvalue()


@pytest.mark.parametrize("size", [150, 700])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_over_lines(spark, tmp_path, size, end):
    body = table(70, size)
    path = put(tmp_path, "a.csv", as_csv(body, end))
    with splits_of(spark, size):
        got = read_csv(spark, path, row_order=True).orderBy("_row_order").drop("_row_order").collect()
    assert [tuple(r) for r in got] == [tuple(c or None for c in r) for r in body]


def test_files_with_and_without_such_cells(spark, tmp_path):
    body = [["1", "x\ny", "", "z"], ["2", "p", "q", "r"]]
    put(tmp_path, "part 2.csv", "\n\n" + as_csv(body) + "\n \n")
    put(tmp_path, "part 10.csv", as_csv([["3", "u", "v", "w"]]))
    put(tmp_path, "part 11.csv", as_csv([], header=["ID", "A", "B", "C"]))
    want = [("1", "x\ny", None, "z"), ("2", "p", "q", "r"), ("3", "u", "v", "w")]
    for multiline in (None, True):
        frame = read_csv(spark, str(tmp_path), multiline=multiline, row_order=True)
        assert rows(frame.orderBy("_row_order").drop("_row_order")) == want


def test_no_task_reads_a_whole_file(spark, tmp_path):
    path = put(tmp_path, "a.csv", as_csv([[str(i), "x\ny" if i == 500 else "x", "y" * 50, "z"] for i in range(1000)]))
    with splits_of(spark, 10_000):
        frame = read_csv(spark, path)
        assert frame.count() == 1000
        lines = read_pieces(spark, path, "\n")
        assert lines.groupBy("_block").count().count() > 5


@pytest.mark.parametrize(
    ("text", "match"),
    [
        ('a,b\n"x\ny",1,2\n', "more than 2 cells"),
        ('a,b\r"x\ny",1\rz,2\r', "carriage return"),
    ],
)
def test_what_raises(spark, tmp_path, text, match):
    with pytest.raises(Exception, match=match):
        read_csv(spark, put(tmp_path, "a.csv", text)).collect()


def test_headers_must_agree(spark, tmp_path):
    put(tmp_path, "a.csv", 'a,b\n"x\ny",1\n')
    put(tmp_path, "b.csv", 'a,c\n"x\ny",1\n')
    with pytest.raises(Exception, match="does not conform"):
        read_csv(spark, str(tmp_path)).collect()


def test_odd_names_and_repaired_headers(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'x.y,,x.y,"a `b\n"\n"1\n",2,3,4\n')
    frame = read_csv(spark, path)
    assert frame.columns == ["x.y", "Unnamed: 1", "x.y.1", "a `b\n"]
    assert rows(frame) == [("1\n", "2", "3", "4")]
    assert frame.select(col("a `b\n")).first()[0] == "4"

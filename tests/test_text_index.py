"""Searches over gram filters: the rows of a full scan, from fewer files."""

import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewright.operators import text_index as ti
from framewright.operators.querying import contains_text

WORDS = ["alpha", "Beta", "gamma", "delta42", "STRASSE", "ſtone", "Kelvin", "İst", "ınk", "naïve", "a.b", "x|y", "nan"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Twenty files, each with words of its own, nulls, empty and long texts."""
    root = tmp_path_factory.mktemp("texts")
    path, store = str(root / "data"), str(root / "store")
    rng = random.Random(3)
    made = []
    for f in range(20):
        own = [f"only{f}x", *rng.sample(WORDS, 2)]
        for i in range(12):
            text = rng.choice([None, "", "ab", " ".join(rng.choices(own, k=rng.randrange(1, 9)))])
            made.append((f, i, text))
        made.append((f, 99, " ".join(rng.choices(own, k=4000))))
    df = spark.createDataFrame(made, "f int, i int, `t x` string")
    df.repartition(20, "f").write.partitionBy("f").parquet(path)
    assert len(ti.update_text_index(spark, path, "t x", store)) >= 20
    assert ti.update_text_index(spark, path, "t x", store) == []
    return path, store


PATTERNS = [
    "only7x", "ONLY7X", "only1.?x", "only(7|8)x", "only7x|only8x", "only7x|zz", "alpha", "be[t]a", "gam+a", "delta\\d+", "delta42?",
    "strasse", "stone", "kelvin", "ist", "ink", "na.ve", "a\\.b", "x\\|y", "nan", "", "absent", "(?:alpha)", "(alpha)?only3x",
    "only3x{0,2}", "^only3x$", "\\x6fnly3x", "only3x(?= )", "[oO]nly3x", "only[0-9]x",
]


@pytest.mark.parametrize("match_null_text", [False, True])
def test_rows_of_a_full_scan(spark, indexed, match_null_text):
    path, store = indexed
    whole = spark.read.parquet(path)
    for pattern in PATTERNS:
        got = ti.search_files(spark, path, "t x", pattern, store, match_null_text=match_null_text)
        want = whole.filter(contains_text(whole, "t x", pattern, False, match_null_text))
        assert rows(got.data.select("f", "i"), "f", "i") == rows(want.select("f", "i"), "f", "i"), pattern


def test_files_are_skipped(spark, indexed):
    path, store = indexed
    total = ti.search_files(spark, path, "t x", "[a-z]", store)
    assert len(total.opened) == total.files >= 20
    one = ti.search_files(spark, path, "t x", "only7x", store)
    assert len(one.opened) < total.files / 3
    both = ti.search_files(spark, path, "t x", "only7x|only8x.*alpha", store)
    assert len(one.opened) <= len(both.opened) < total.files / 2
    assert ti.search_files(spark, path, "t x", "a.b absent", store, literal=True).opened == []
    assert ti.search_files(spark, path, "t x", "zzzqqq", store).data.collect() == []


def test_bits_are_combined_without_sorting_grams(spark, indexed):
    """Hash aggregates hold a file's few words; a sort would hold a row per gram of every text."""
    path, store = indexed
    filters = ti.file_filters(spark.read.parquet(path), "t x")
    assert "SortAggregate" not in filters._jdf.queryExecution().executedPlan().toString()
    bits = filters.select("file", F.explode(F.sequence(F.lit(0), F.length("bitmap") - 1)).alias("i"), "bucket", "bitmap")
    byte = F.conv(F.hex(F.substring("bitmap", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    got = bits.select("file", "bucket", "i", byte.alias("byte")).filter("byte > 0")
    assert filters.filter(F.length("bitmap") != 4096).count() == 0
    text = ti._folded(F.coalesce(F.col("`t x`"), F.lit("nan")))
    grams = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), text.alias("t"))
    grams = grams.select("file", F.explode(F.expr("transform(sequence(1, greatest(length(t) - 2, 1)), i -> substr(t, i, 3))")).alias("g"))
    bit = F.when(F.length("g") == 3, ti._bit(F.col("g"))).otherwise(ti._bit(F.lit(None).cast("string")))
    want = grams.select("file", F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("p")).distinct()
    want = want.groupBy("file", "bucket", F.expr("int(p / 8)").alias("i")).agg(F.sum(F.expr("shiftleft(1, int(p % 8))")).alias("byte"))
    assert rows(got, "file", "bucket", "i") == rows(want, "file", "bucket", "i")


def test_new_files_are_opened_until_indexed(spark, tmp_path):
    path, store = str(tmp_path / "d"), str(tmp_path / "s")
    spark.createDataFrame([("first text",)], "t string").coalesce(1).write.parquet(path)
    assert len(ti.search_files(spark, path, "t", "first", store).opened) == 1
    ti.update_text_index(spark, path, "t", store)
    spark.createDataFrame([("second text",)], "t string").coalesce(1).write.mode("append").parquet(path)
    found = ti.search_files(spark, path, "t", "second", store)
    assert rows(found.data) == [("second text",)] and len(found.opened) == 1 < found.files
    ti.update_text_index(spark, path, "t", store)
    assert len(ti.search_files(spark, path, "t", "first", store).opened) == 1


def test_required_words():
    """Every word is in every match, and patterns in doubt require nothing."""
    assert ti.required_words("abc.*def|ghi+") == [["abc", "def"], ["ghi"]]
    assert ti.required_words("abcd?e") == [["abc"]]
    for doubtful in ("\\Qabc\\E", "\\x41bcd", "(?x)a b c d", "[[abc]]def", "abc\\p{L}def"):
        assert ti.required_words(doubtful) == [[]]
    rng = random.Random(5)
    bits = ["abc", "xyz", "q", ".", ".*", "d?", "e+", "(fgh|ijk)", "[lm]n", "\\d", "\\.", "|", "no{2}", "^", "(?:pqr)*"]
    for _ in range(400):
        pattern = "".join(rng.choices(bits, k=rng.randrange(1, 6)))
        words = ti.required_words(pattern)
        for _ in range(5):
            text = "".join(rng.choices(["abc", "xyz", "q", "fgh", "ijk", "ln", "7", ".", "noo", "d", "eee", "pqr"], k=6))
            if re.search(pattern, text):
                assert any(all(w in text for w in branch) for branch in words), (pattern, text)

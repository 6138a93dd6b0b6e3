"""Text filters that open only the files that can hold a match.

Every file has a Bloom filter of the three-letter grams of a text column. A
search needs certain words of its pattern to occur; files whose filter lacks
one of their grams are not opened. The others are searched as ever, so the
rows are those of a full scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.columns import col
from framewright.functions.fixed_values import NULL_TEXT
from framewright.operators.profile_store import FILE_KEYS, files_of
from framewright.operators.querying import contains_text
from framewright.session import stored_or_empty

GRAM = 3
# Bits of a file's filter; bitmaps hold 32,768 each.
FILTER_BITS = 1 << 18
_BITMAP_BITS = 1 << 15

INDEX_SCHEMA = "file string, file_size bigint, modified timestamp, column string, bucket bigint, bitmap binary"

# Letters that a search without regard to case takes for s, k and i.
_ALIKE = ("ſKİı", "skii")
# Escapes that stand for a class of letters or a place; others may take arguments.
_CLASS_ESCAPES = "dDwWsSbBAzZtnrfaevhHVRGX"


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, *_ALIKE))


def _bit(gram: Column) -> Column:
    """The number of a gram's bit, from 1 on as bitmaps count."""
    return F.pmod(F.xxhash64(gram), F.lit(FILTER_BITS)) + 1


def _in_word(position: Column) -> Column:
    """The bit at a position of a bitmap's eight bytes, as a number whose first byte is the highest."""
    shift = (F.lit(7) - (position / 8).cast("int")) * 8 + position % 8
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift.cast("int"))


def _bitmap(words: Column) -> Column:
    """A bucket's bytes from its words by number; words without a bit are missing."""
    every = F.sequence(F.lit(0), F.lit(_BITMAP_BITS // 64 - 1))
    texts = F.transform(every, lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(words, i), F.lit(0))), 16, "0"))
    return F.unhex(F.array_join(texts, ""))


def file_filters(df: DataFrame, column: str) -> DataFrame:
    """(file, size, time, column, bucket, bitmap) of a frame that was read from files.

    Missing cells count as the text they are shown as. Bits are combined on
    each task, so a file costs each of its tasks a few bitmaps.
    """
    text = _folded(F.coalesce(col(column).cast("string"), F.lit(NULL_TEXT)))
    letters = df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.split(text, "").alias("letters"),
    )
    last = F.size("letters") - GRAM
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        return F.concat(*[F.get("letters", i + k) for k in range(GRAM)])

    grams = letters.select(*FILE_KEYS, F.explode_outer(F.array_distinct(F.transform(at, gram))).alias("gram"))
    # Bits are combined as words of 64: hash aggregates hold long numbers, but sort their input for bitmaps.
    bit = F.coalesce(_bit(F.col("gram")), F.lit(1))
    at, position = F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit")
    words = (
        grams.select(*FILE_KEYS, bit.alias("bit"))
        .select(*FILE_KEYS, at, position.alias("position"))
        .groupBy(*FILE_KEYS, "bucket", (F.col("position") / 64).cast("int").alias("word"))
        .agg(F.bit_or(_in_word(F.col("position") % 64)).alias("bits"))
    )
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    return (
        words.groupBy(*FILE_KEYS, "bucket")
        .agg(held.alias("held"))
        .select(*FILE_KEYS, F.lit(column).alias("column"), "bucket", _bitmap(F.col("held")).alias("bitmap"))
    )


def update_text_index(
    spark: SparkSession, path, column: str, store: str, format: str = "parquet", **options
) -> list[str]:
    """Index the files that the store doesn't know, or knows with another size or time; returns them."""
    known = stored_or_empty(spark, store, INDEX_SCHEMA).filter(F.col("column") == column)
    new = files_of(spark, path).join(known.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_anti")
    names = [r["file"] for r in new.select("file").collect()]  # the driver plans scans from such lists
    if names:
        frame = spark.read.format(format).options(**options).load(path)
        chosen = frame.filter(F.col("_metadata.file_path").isin(names))
        file_filters(chosen, column).write.mode("append").parquet(store)
    return sorted(names)


def _branches(pattern: str) -> list[str]:
    """The alternatives at the top of a pattern."""
    parts, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _runs(branch: str) -> list[str]:
    """Runs of plain letters that every match of the branch holds; none where the syntax leaves a doubt."""
    runs, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(branch):
        c = branch[i]
        if c == "\\":
            i += 1
            escaped = branch[i : i + 1]
            if escaped.isalnum():
                if escaped not in _CLASS_ESCAPES:
                    return []
                end()
            elif escaped.isascii() and escaped:
                run += escaped
            else:
                return []
        elif c == "[":
            close = branch.find("]", i + 2)
            if close < 0 or "[" in branch[i + 1 : close] or "\\" in branch[i + 1 : close]:
                return []
            end()
            i = close
        elif c == "(":
            if branch[i + 1 : i + 2] == "?" and branch[i + 2 : i + 3] not in (":", "=", "!", "<", ">"):
                return []
            depth, j = 1, i + 1
            while j < len(branch) and depth:
                if branch[j] in "\\[":
                    return []
                depth += {"(": 1, ")": -1}.get(branch[j], 0)
                j += 1
            end()
            i = j - 1
        elif c in "*?{":
            run = run[:-1]
            end()
            if c == "{":
                close = branch.find("}", i)
                if close < 0:
                    return []
                i = close
        elif c in "+.^$":
            end()
        elif c.isascii():
            run += c
        else:
            end()
        i += 1
    end()
    return [r.lower() for r in runs if len(r) >= GRAM]


def required_words(pattern: str, literal: bool = False) -> list[list[str]]:
    """For each alternative of a pattern the words that a match must hold; empty lists tell nothing."""
    if literal:
        plain = "".join(c if c.isascii() else "\0" for c in pattern.lower())
        return [[w for w in plain.split("\0") if len(w) >= GRAM]]
    return [_runs(b) for b in _branches(pattern)]


class Found(NamedTuple):
    data: DataFrame
    opened: list[str]
    files: int


def search_files(
    spark: SparkSession, path, column: str, pattern: str, store: str,
    literal: bool = False, match_null_text: bool = False, format: str = "parquet", **options,
) -> Found:
    """The rows a full scan would find, from the files that can hold them; files the store doesn't know are opened."""
    every = files_of(spark, path)
    names = [r["file"] for r in every.select("file").collect()]
    frame = spark.read.format(format).options(**options).load(path)
    alternatives = required_words(pattern, literal)
    opened = names
    if all(alternatives):
        grams = [
            (i, word[k : k + GRAM])
            for i, words in enumerate(alternatives)
            for word in words
            for k in range(len(word) - GRAM + 1)
        ]
        wanted = spark.createDataFrame(sorted(set(grams)), "alternative int, gram string")
        wanted = wanted.withColumn("bit", _bit(F.col("gram")))
        wanted = wanted.select("alternative", "gram", F.bitmap_bucket_number("bit").alias("bucket"),
                               F.bitmap_bit_position("bit").alias("position"))
        index = stored_or_empty(spark, store, INDEX_SCHEMA).filter(F.col("column") == column)
        index = index.join(every, FILE_KEYS, "left_semi")
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10)
        is_set = F.getbit(byte.cast("bigint"), (F.col("position") % 8).cast("int")) == 1
        needed = wanted.groupBy("alternative").agg(F.count_distinct("gram").alias("n"))
        held = (
            index.join(F.broadcast(wanted), "bucket")
            .filter(is_set)
            .groupBy("file", "alternative")
            .agg(F.count_distinct("gram").alias("held"))
            .join(F.broadcast(needed), "alternative")
            .filter(F.col("held") == F.col("n"))
        )
        known = {r["file"] for r in index.select("file").distinct().collect()}
        able = {r["file"] for r in held.select("file").distinct().collect()}
        opened = [n for n in names if n not in known or n in able]
    chosen = frame.filter(F.col("_metadata.file_path").isin(opened)) if opened else frame.filter(F.lit(False))
    rows = chosen.filter(contains_text(frame, column, pattern, literal, match_null_text))
    return Found(rows, sorted(opened), len(names))

"""Text files cut at a separator that their records may also hold, by many tasks.

A task that reads a split can't know whether it starts inside a quoted cell or
a nested value: that depends on all the text before. So pieces are cut at every
separator, whatever it means there. What a piece does to the state (quotes
opened, depth gained) is a number, and the state before a piece is the sum of
those numbers over the pieces before it in its file: a running sum inside a run of
neighbouring pieces, plus the sums of the runs before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.columns import col
from framewright.session import reliable

# A piece's file, the file's name, the split it was read in, its run and place there, and its text.
FILE, NAME, BLOCK, RUN, ROW, TEXT = "_file", "_name", "_block", "_run", "_row", "_text"
KEYS = [FILE, NAME, BLOCK, RUN, ROW, TEXT]

# Pieces of a run are 2**RUN_BITS at most, so that no sum needs a whole split in one task.
RUN_BITS = 14
# Bytes of pieces that a task sorts, and bytes a piece takes besides its text (mostly the file's path).
TASK_BYTES, PIECE_BYTES = 64 << 20, 300


def read_pieces(
    spark: SparkSession, path, separator: str, chosen: Column | None = None, **facts: Column
) -> DataFrame:
    """Pieces without their separators, as ``KEYS``; partition columns of the path come first.

    ``chosen`` picks files by their metadata; ``facts`` are columns over
    ``TEXT``. The pieces are written, so that their numbers are the same
    wherever they are read.
    """
    scan = spark.read.option("lineSep", separator).text(path)
    scan = scan if chosen is None else scan.filter(chosen)
    pieces = scan.select(
        *[col(n) for n in scan.columns if n != "value"],
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_name").alias(NAME),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW),
        F.col("value").alias(TEXT),
        F.col("_metadata.file_size").alias("_file_size"),
    )
    pieces = pieces.withColumn(RUN, F.shiftright(ROW, RUN_BITS))
    return reliable(pieces.withColumns(facts) if facts else pieces)


def tasks_for(pieces: DataFrame) -> int:
    """How many tasks the pieces are dealt to; packed shuffle files say little about the rows in memory."""
    held = pieces.select(F.sum(F.octet_length(TEXT) + PIECE_BYTES)).first()[0] or 0
    return held // TASK_BYTES + 1


def running(pieces: DataFrame, value: Column, name: str, tasks: int | None = None) -> DataFrame:
    """``pieces`` with the sum of ``value`` over the pieces before each in its file, as ``name``.

    The sum runs over the pieces of a run. One row per run is broadcast, which
    is one per 2**RUN_BITS pieces and split. ``tasks`` deals the runs to so many
    tasks first; sums after the first find them dealt.
    """
    run = [FILE, BLOCK, RUN]
    within = W.partitionBy(*run).orderBy(ROW).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("_f").orderBy("_b", "_r").rowsBetween(W.unboundedPreceding, -1)
    totals = pieces.groupBy(F.col(FILE).alias("_f"), F.col(BLOCK).alias("_b"), F.col(RUN).alias("_r"))
    totals = totals.agg(F.sum(value).alias("_sum"))
    starts = totals.select("_f", "_b", "_r", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    dealt = pieces.repartition(tasks, *run) if tasks else pieces
    joined = dealt.join(
        F.broadcast(starts),
        (F.col(FILE) == F.col("_f")) & (F.col(BLOCK) == F.col("_b")) & (F.col(RUN) == F.col("_r")),
    )
    here = F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(name, here).drop("_f", "_b", "_r", "_start")


def joined_text(separator: str) -> Column:
    """The grouped pieces' text, in file order."""
    parts = F.array_sort(F.collect_list(F.struct(BLOCK, ROW, TEXT)))
    return F.array_join(F.transform(parts, lambda p: p[TEXT]), separator)


def count_of(text: Column, letter: str) -> Column:
    """How often a letter of one byte is in the text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))

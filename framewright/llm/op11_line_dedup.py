"""Lines that several documents hold stay only in the first of them.

Normalised lines are exploded with their positions and hashed to 128 bits.
Documents are counted once per hash; lines whose hash is held by too many
documents are dropped wherever the document is not the first to hold it, and
the rest is put together again by position. All of it is DataFrame expressions.

Only hashes, ids and positions are shuffled line by line. A hash that very many
documents hold is merged on every task before the count, and looked up by
broadcast afterwards; texts travel once, to the dropped positions of their own
document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.lookups import lookup_join
from framewright.session import reliable

MIN_CHARS = 10
MIN_DOCUMENTS = 2

# The blanks that are stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case.

    ``lower`` does just that to a line of ASCII; other lines are translated.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    other = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(bare)).otherwise(other)


def _runs(lines: Column, edges: Column) -> Column:
    """The lines strictly between each edge and the next, in order."""

    def run(i: Column) -> Column:
        before, after = F.element_at(edges, i), F.element_at(edges, i + 1)
        return F.slice(lines, before + 2, after - before - 1)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), run))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """doc_id, text (what is kept), n_lines (before), n_dropped; a row per row of ``docs``.

    Lines end at line feeds. A null or empty text is one empty line, and its
    kept text is empty. Keys of at least ``min_chars`` code points that at least
    ``min_documents`` documents hold lose all their lines except in the document
    of the smallest id; there every line stays, repeats included. A document is
    an id: rows that share one are one document, and so are the rows without
    an id, which come after all others. Repeated rows get equal results, an empty
    table gives none, and other columns are ignored.
    """
    source = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # Equal for rows of equal id and text only, whose results are equal too.
    row = _digest(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("|"), F.col("text")))
    source = source.withColumn("row", row)
    document = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"))
    lines = (
        source.select(document.alias("document"), "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .select("document", "row", "at", line_key(F.col("line")).alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .select("document", "row", "at", _digest(F.col("line")).alias("line"))
    )
    # The count of distinct pairs first spreads a hot hash by its documents.
    held = lines.groupBy("line", "document").agg(F.count("*").alias("n"))
    repeated = held.groupBy(F.col("line").alias("key")).agg(
        F.min("document").alias("value"),
        F.sum("n").alias("occurrences"),
        F.count("*").alias("documents"),
    )
    repeated = reliable(
        repeated.filter(F.col("documents") >= min_documents).select("key", "value", "occurrences")
    )
    judged = lookup_join(lines, "line", repeated, "first")
    dropped = (
        judged.filter(F.col("first") != F.col("document"))
        .groupBy(F.col("row").alias("key"))
        .agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    )
    joined = source.join(dropped, F.col("row") == F.col("key"), "left")
    # Columns of their own, so that the lambda below finds them ready for every run.
    edged = joined.withColumn("lines", F.split("text", "\n")).withColumn(
        "edges", F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("lines")))
    )
    some = F.col("dropped").isNotNull()
    kept = F.array_join(_runs(F.col("lines"), F.col("edges")), "\n")
    return edged.select(
        F.col("id").alias("doc_id"),
        F.when(some, kept).otherwise(F.col("text")).alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(some, F.size("dropped")).otherwise(0).cast("bigint").alias("n_dropped"),
    )


def line_digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

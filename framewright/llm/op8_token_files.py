"""Token ids in Parquet list columns that can be read selectively.

One row per document, in ascending order of id: the list of token ids, and
beside it the metadata (count, part, offset inside the part) in columns of
their own, so that a reader of lengths or positions never touches the ids. Ids
are dictionary-encoded: some 50,000 distinct values fit a dictionary page, and
each id then takes the bits of its index. Small row groups and pages, with the
page indexes that the Parquet writer adds, let a reader of a few documents skip
the rest.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.session import setting

LAYOUT = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
FILE_SCHEMA = "doc_id bigint, part int, part_offset bigint, n_tokens bigint, ids array<int>"
# Bytes of the texts whose words are looked up together.
SLICE_BYTES = 4 << 20
# Words that are encoded as one text, and such texts that are encoded at once.
_TOGETHER, _AT_ONCE = 1_000, 16
# Words whose ids are kept from slice to slice, and the longest such word in bytes.
KEPT_WORDS, KEPT_BYTES = 250_000, 64
# Empty words, and words with a blank at an end; texts that hold one are encoded whole.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ODD_WORD = rf"^$|^[{_BLANKS}]|[{_BLANKS}]\z"


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


class Encoder:
    """Exact ids of whole texts, encoding each distinct word of a slice once.

    The byte-level pre-tokenizer never joins characters on both sides of a
    single space between two non-blanks: the space starts the next piece, and
    so a token. So a text whose spaces all stand alone is the concatenation of
    its first word and of its other words with a space before each. Distinct
    words are encoded together, a space before each, and told apart by the tokens
    that start with one. Texts with other runs of blanks, or with a special token,
    are encoded whole. The ids of words that two slices in a row had to encode
    are kept for later slices, for a bounded number of words.
    """

    def __init__(self, path: str, room: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # A space is printed as this letter in byte-level vocabularies.
        self.led = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            self.led[i] = token.startswith("\u0120")
        # Words whose ids are kept, those ids, and the words that the last slice encoded.
        self.room = room
        self.kept, self.kept_ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        self.last = self.kept

    def all_at_once(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, dtype="<u4") for c in coded]

    def led_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each, none of them odd, and where each word's begin."""
        edges = pa.array([*range(0, len(words), _TOGETHER), len(words)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(edges, words), " ") if len(words) else []
        coded = [np.zeros(0, dtype="<u4")]
        for at in range(0, len(joined), _AT_ONCE):
            coded += self.all_at_once([f" {text}" for text in joined[at : at + _AT_ONCE].to_pylist()])
        flat = np.concatenate(coded)
        starts = np.flatnonzero(self.led[flat])
        counts = [int(self.led[c].sum()) for c in coded[1:]]
        if counts != np.diff(edges.to_numpy()).tolist()[: len(counts)]:
            raise ValueError("a token of this vocabulary holds a space behind other letters")
        return flat, starts

    def keep(self, new: pa.Array, ids: pa.Array) -> None:
        """Keep the ids of words that this slice and the one before had to encode, as far as there is room."""
        if len(self.kept) >= self.room:
            return
        again = pc.and_(pc.index_in(new, value_set=self.last).is_valid(), pc.less_equal(pc.binary_length(new), KEPT_BYTES))
        which = pc.indices_nonzero(again)[: self.room - len(self.kept)]
        self.kept = pa.concat_arrays([self.kept, new.take(which)])
        self.kept_ids = pa.concat_arrays([self.kept_ids, ids.take(which)])
        self.last = new

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        # A special token makes its text odd, as an empty first word does.
        plain = texts
        for special in self.special:
            plain = pc.if_else(pc.match_substring(plain, special), "", plain)
        split = pc.split_pattern(plain, " ")
        edges = split.offsets.to_numpy()
        words = split.values.dictionary_encode()
        at, heads = words.indices.to_numpy().copy(), edges[:-1]
        first, nth = np.unique(at[heads], return_inverse=True)
        follows = np.ones(len(at), dtype=bool)
        follows[heads] = False
        used = np.zeros(len(words.dictionary), dtype=bool)
        used[at[follows]] = True
        held = pc.index_in(words.dictionary, value_set=self.kept)
        is_held = held.is_valid().to_numpy(zero_copy_only=False)
        odd_word = np.zeros(len(used), dtype=bool)
        odd_word[~is_held] = pc.match_substring_regex(
            words.dictionary.filter(pa.array(~is_held)), _ODD_WORD
        ).to_numpy(zero_copy_only=False)
        # Entries: kept words, other words behind others, then distinct first words; the last stands for all odd ones.
        plain_rest = used & ~odd_word & ~is_held
        rest = np.flatnonzero(plain_rest)
        odd = len(self.kept) + len(rest) + len(first)
        place = np.full(len(used), odd, dtype=np.int32)
        place[is_held] = held.drop_null().to_numpy()
        place[rest] = len(self.kept) + np.arange(len(rest))
        at = place[at]
        at[heads] = np.where(odd_word[first], odd, odd - len(first) + np.arange(len(first)))[nth]
        new = words.dictionary.take(pa.array(rest))
        flat, starts = self.led_words(new)
        new_ids = _lists(flat, np.append(starts, len(flat)))
        begun = words.dictionary.take(pa.array(first[~odd_word[first]])).to_pylist()
        lengths = np.zeros(len(first) + 1, dtype=np.int64)
        coded = [np.zeros(0, dtype="<u4"), *self.all_at_once(begun)]
        lengths[:-1][~odd_word[first]] = list(map(len, coded[1:]))
        first_ids = _lists(np.concatenate(coded), np.append(0, np.cumsum(lengths)))
        entries = pa.concat_arrays([self.kept_ids, new_ids, first_ids])
        self.keep(new, new_ids)
        ids = entries.take(pa.array(at))
        flat, cuts = ids.values.to_numpy(), ids.offsets.to_numpy()[edges]
        found = [flat[a:b].tobytes() for a, b in itertools.pairwise(cuts.tolist())]
        whole = np.flatnonzero(np.logical_or.reduceat(at == odd, heads))
        for i in whole.tolist():
            found[i] = self.all_at_once([texts[i].as_py()])[0].tobytes()
        return found


@functools.lru_cache(maxsize=1)
def _encoder(path: str, room: int) -> Encoder:
    return Encoder(path, room)


def _runs(texts: pa.Array, slice_bytes: int) -> Iterator[int]:
    """Lengths of runs of texts of about ``slice_bytes`` bytes; a longer text is a run of its own."""
    held = n = 0
    for size in pc.binary_length(texts).to_pylist():
        held, n = held + size, n + 1
        if held >= slice_bytes:
            yield n
            held = n = 0
    if n:
        yield n


def _encode(tokenizer: str, end_id: int, room: int, slice_bytes: int = SLICE_BYTES):
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(ids: list, part: int, starts: list[int], coded: list[bytes]) -> pa.RecordBatch:
        lengths = [len(b) // 4 for b in coded]
        flat = np.frombuffer(b"".join(coded), dtype="<i4")
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([part] * len(ids), pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            names=["doc_id", "part", "part_offset", "n_tokens", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(tokenizer, room), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts, taken = batch.column(0).to_pylist(), batch.column(1), 0
            for n in _runs(texts, slice_bytes):
                coded = [c + end for c in encoder.encode(texts.slice(taken, n))]
                lengths = [len(c) // 4 for c in coded]
                starts = [at + before for before in itertools.accumulate(lengths, initial=0)]
                yield rows(ids[taken : taken + n], part, starts[:-1], coded)
                at, taken = starts[-1], taken + n
                # Workers live on: what Arrow holds for reuse would add up beside other stages.
                pa.default_memory_pool().release_unused()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept_words: int = KEPT_WORDS,
    slice_bytes: int = SLICE_BYTES,
    batch_rows: int | None = None,
) -> None:
    """Encode every text and write the files, ascending in id, null ids first.

    A null text has no ids but the end id; rows of equal id are ordered by
    text, repeated rows are kept; an empty table gives files without rows.
    Other columns are ignored. One task holds one range of ids and writes one
    part; inside it ``part_offset`` counts the ids of the rows before. ``kept_words``:
    words whose ids a process keeps; fewer, like fewer ``slice_bytes`` of texts that
    are encoded together, take less memory beside other stages and more time; so do
    fewer ``batch_rows``, the rows that travel to Python at once (None: as the session says).
    """
    picked = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ordered = (
        picked.repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    coded = ordered.mapInArrow(_encode(tokenizer, end_id, kept_words, slice_bytes), FILE_SCHEMA)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with setting(docs.sparkSession, rows, str(batch_rows)) if batch_rows else contextlib.nullcontext():
        coded.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``: the ids of all documents before.

    Totals of the parts (one small row per part, read from a metadata column)
    are accumulated in part order and broadcast.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        "part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start")
    )
    return files.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("part_start") + F.col("part_offset")).alias("start"), "n_tokens", "ids"
    )


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Ids of documents from ``low`` to ``high``: row groups and pages outside are skipped."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return files.filter(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit numbers."""
    return tokens.mapInArrow(_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

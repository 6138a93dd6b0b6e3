"""Alignment of two tokenizers' tokens by their byte offsets.

Every text is encoded by a byte-level vocabulary (A) and by a vocabulary of
pieces (B). Both give ascending lists of byte offsets at which tokens end. The
shorter list drives an exponential search, finished by bisection, into the
longer one: offsets found in both cut the tokens into groups, and the ranks
found for the two ends of a token are the range of tokens it overlaps.

Links are counted by id pair over the corpus. The most frequent pairs, bounded
in number, are broadcast; all others are joined by shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.session import reliable

# Pairs whose counts are broadcast: at most this many, of 17 bytes each.
KNOWN_PAIRS = 1 << 20
# Letters of the texts that are encoded together.
SLICE_CHARS = 1 << 20

# Fixed value: the letter that stands for a space in pieces.
SPACE = "▁"
# Fixed value: how byte-level vocabularies of this kind cut a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LINKED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs array<bigint>, times array<int>"
)
_SUMMED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<int>"
)
_META = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def intersect(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int], bool]:
    """(``firsts``, ``lasts``, whether ``b`` drives) for two lists of ends, ascending and ending alike.

    Token i of the driving, shorter list overlaps the tokens ``firsts[i]`` to
    ``lasts[i]`` of the other: from the rank behind its start to the rank of
    its end. Each rank is sought from the last one on, in steps that double,
    then by bisection. A token's end is in both lists where the next token's
    first is behind its last.
    """
    swapped = len(b) < len(a)
    short, long = (b, a) if swapped else (a, b)
    firsts, lasts, first, top = [], [], 0, len(long) - 1
    for end in short:
        at = first
        if long[at] < end:
            low, step = at + 1, 1
            high = low
            while long[high] < end:
                low = high + 1
                step *= 2
                high = min(high + step, top)
            at = bisect_left(long, end, low, high)
        firsts.append(first)
        lasts.append(at)
        first = at + (long[at] == end)
    return firsts, lasts, swapped


def _byte_letters() -> dict[str, int]:
    """The byte of each letter in byte-level vocabularies: printable bytes stand
    for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _texts_of(ids: int, ends: str) -> np.ndarray:
    """The decimal of every id with each of the marks behind it, a row per mark."""
    return np.array([[f"{i}{e}".encode() for i in range(ids)] for e in ends], dtype=object)


class Aligned:
    """Tokens, groups and links of one text."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: list[int], ends_b: list[int]):
        self.a, self.b = a, b
        firsts, lasts, swapped = intersect(ends_a, ends_b)
        first, last = np.array(firsts), np.array(lasts)
        own = np.arange(len(first))
        n = last - first + 1
        # Links in the order of the driving tokens: each with its range of the other's.
        drives = np.repeat(own, n)
        other = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        i, j = (other, drives) if swapped else (drives, other)
        self.links = a[i] << 32 | b[j]
        shared = np.append(first[1:], last[-1] + 1) > last
        cuts = own[shared] + 1, last[shared] + 1
        self.cuts_a, self.cuts_b = cuts[::-1] if swapped else cuts

    def groups(self, texts_a: np.ndarray, texts_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: every token is laid where its group puts it."""
        ends_a, ends_b = np.zeros(len(self.a), dtype=int), np.zeros(len(self.b), dtype=int)
        ends_a[self.cuts_a - 1] = ends_b[self.cuts_b - 1] = 1
        n_a, n_b = np.diff(self.cuts_a, prepend=0), np.diff(self.cuts_b, prepend=0)
        laid = np.empty(len(self.a) + len(self.b), dtype=object)
        laid[np.arange(len(self.a)) + np.repeat(self.cuts_b - n_b, n_a)] = texts_a[ends_a, self.a]
        laid[np.arange(len(self.b)) + np.repeat(self.cuts_a, n_b)] = texts_b[ends_b, self.b]
        return b"".join(laid.tolist())[:-1]


class Aligner:
    """Aligned texts, for the vocabulary files of both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        # Strings of special tokens inside texts are plain text.
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for t, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.fast_a = self._ranked(json.loads(self.a.to_str()))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(
                bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            )
        self.lengths = [np.array([len(t) for t in known]) for known in (self.bytes_a, self.bytes_b)]
        self.texts = _texts_of(len(self.bytes_a), ",|"), _texts_of(len(self.bytes_b), ",;")

    def _ranked(self, told: dict):
        """The same vocabulary as merge ranks, which encode faster; None where ids don't follow the merges.

        Where the n-th merge makes the n-th id behind the single bytes, merging
        by lowest id is merging in the order of the merges.
        """
        import tiktoken

        model, cut = told["model"], told["pre_tokenizer"] or {}
        plain = (
            told["normalizer"] is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        if not plain:
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        vocab, letters = model["vocab"], _byte_letters()
        special = {t["content"] for t in told["added_tokens"]}
        singles = len(vocab) - len(merged) - len(special & vocab.keys())
        if singles != 256 or any(vocab.get(t) != singles + n for n, t in enumerate(merged)):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids in A of a space and each text, and in B of each text."""
        led = [" " + t for t in texts]
        if self.fast_a:
            a = [self.fast_a.encode_ordinary(t) for t in led]
        else:
            a = [e.ids for e in self.a.encode_batch_fast(led, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def align(self, texts: list[str]) -> Iterator[Aligned | None]:
        """None where the bytes of A's or B's tokens aren't a space and the text."""
        for text, a, b in zip(texts, *self.encode(texts), strict=True):
            whole = (" " + text).encode()
            if whole != b"".join([self.bytes_a[i] for i in a]) or whole != b"".join([self.bytes_b[i] for i in b]):
                yield None
                continue
            ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            ends_a, ends_b = (np.cumsum(n[i]).tolist() for n, i in zip(self.lengths, (ids_a, ids_b), strict=True))
            yield Aligned(ids_a, ids_b, ends_a, ends_b)


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, some = 0, []
    for text in texts:
        some.append(text)
        held += len(text or "")
        if held >= SLICE_CHARS:
            yield some
            held, some = 0, []
    if some:
        yield some


def _link(path_a: str, path_b: str, groups: bool):
    none = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for some in _slices(batch.column(1).to_pylist()):
                aligned = aligner.align([t for t in some if t])
                counts, digests, texts, pairs, times = [], [], [], [], []
                for text in some:
                    found = next(aligned) if text else None
                    if found is None:
                        counts.append((0, 0, 0, 0))
                        texts.append("")
                        digests.append("")
                        pairs.append(none)
                        times.append(none)
                        continue
                    counts.append((len(found.a), len(found.b), len(found.cuts_a), len(found.links)))
                    whole = found.groups(*aligner.texts)
                    texts.append(whole.decode() if groups else "")
                    digests.append(hashlib.sha256(whole).hexdigest())
                    pair, n = np.unique(found.links, return_counts=True)
                    pairs.append(pair)
                    times.append(n)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
                columns = [
                    pa.array(range(row, row + len(some)), pa.int64()),
                    pa.array(ids[at : at + len(some)], pa.int64()),
                    *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)],
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pairs), pa.int64())),
                    pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.concatenate(times).astype(np.int32), pa.int32())
                    ),
                ]
                names = ["row", *_META, "groups_sha256", "pairs", "times"]
                if groups:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("groups")
                row += len(some)
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: bool = False,
) -> DataFrame:
    """A row per document: token counts, groups, links, and the linked id pairs with how often.

    ``pairs`` holds ``a << 32 | b`` in ascending order and ``times`` the number of
    its links; ``groups`` adds the groups as text, ``a1,a2|b1;a3|b2,b3``. A null or
    empty text, and one whose tokens' bytes in A or B are not those of a space
    and the text, has no tokens: zeros, empty lists, an empty digest. Repeated
    rows are rows of their own; an empty table gives none; other columns are
    ignored. ``row`` numbers the rows and is only fixed once the result is written.
    """
    picked = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    schema = _LINKED + (", groups string" if groups else "")
    return picked.mapInArrow(_link(path_a, path_b, groups), schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, documents, best): documents that hold the pair linked, and whether it is its A id's highest.

    Pairs are merged on each task. An A id meets at most the ids of B in one task.
    """
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("documents")
    )
    own = W.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(own))


def _sum(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents, best = held.value
        for batch in batches:
            names = batch.schema.names
            pairs, times = (batch.column(names.index(c)) for c in ("pairs", "times"))
            ends = pairs.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            pair = pairs.flatten().to_numpy(zero_copy_only=False)
            n = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[at] == pair
            else:
                at, hit = np.zeros(len(pair), dtype=np.int64), np.zeros(len(pair), dtype=bool)

            def total(values: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values)])
                return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

            near = np.where(hit, n, 0)
            counted = total(near * documents[at] if len(keys) else near)
            chosen = total(near * best[at] if len(keys) else near)
            left = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(names.index(c)) for c in ("row", *_META, "groups_sha256")],
                    chosen,
                    counted,
                    pa.ListArray.from_arrays(pa.array(left), pa.array(pair[~hit], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(left), pa.array(n[~hit].astype(np.int32), pa.int32())),
                ],
                names=["row", *_META, "groups_sha256", "n_best", "count_sum", "rest", "rest_times"],
            )

    return run


def link_counts(linked: DataFrame, counts: DataFrame, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of written ``align`` rows.

    ``counts`` are the written pair counts. At most about ``known_pairs`` of the
    most frequent pairs are broadcast; documents send the pairs beyond them, with
    their row numbers, to a join by pair. No such pair is in many documents.
    """
    spark = linked.sparkSession
    n = counts.count()
    known, over = counts, None
    if n > known_pairs:
        over = counts.agg(
            F.percentile_approx("documents", F.lit(1 - known_pairs / n), F.lit(100_000))
        ).first()[0]
        known = counts.filter(F.col("documents") > over)
    table = known.select("pair", "documents", "best").toArrow()
    order = np.argsort(keys := table.column(0).to_numpy())
    arrays = keys[order], table.column(1).to_numpy()[order], table.column(2).to_numpy().astype(np.int64)[order]
    held = spark.sparkContext.broadcast(arrays)
    summed = linked.mapInArrow(_sum(held), _SUMMED)
    out = [*_META, "n_best", "count_sum", "groups_sha256"]
    if over is None:
        return summed.select(*out)
    summed = reliable(summed)
    rare = counts.filter(F.col("documents") <= over)
    loose = summed.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select(
        F.col("row").alias("of"), F.col("r.rest").alias("rest"), F.col("r.rest_times").alias("n")
    )
    more = (
        loose.join(rare, F.col("rest") == F.col("pair"))
        .groupBy("of")
        .agg(
            F.sum(F.col("n") * F.col("best").cast("bigint")).alias("more_best"),
            F.sum(F.col("n") * F.col("documents")).alias("more_sum"),
        )
    )
    both = summed.join(more, F.col("row") == F.col("of"), "left")
    zero = F.lit(0).cast("bigint")
    return both.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", zero),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero),
        }
    ).select(*out)


def alignment_counts(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    known_pairs: int = KNOWN_PAIRS,
) -> DataFrame:
    """Alignment, corpus-wide pair counts, and every document's links held against them."""
    linked = reliable(align(docs, path_a, path_b, id_col, text_col))
    counts = reliable(pair_counts(linked))
    return link_counts(linked, counts, known_pairs)

"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over TRIGGER bytes ends a phrase wherever it is small, so that
equal text is cut alike wherever it stands. All strings of LENGTH bytes that
start inside one phrase share the phrase's end and the bytes behind it, so they
are judged together: a phrase with its context is one entry of the dictionary,
and the table of entries, in the order of the text that follows the phrase and
then of the whole entry, plays the part of the suffix array of the parse. In
that order

* an entry whose following text stands nowhere else holds no repeated string;
* an entry that occurs twice as a whole holds repeated strings only;
* entries that share the following text but differ otherwise are neighbours:
  their strings are compared one by one, by hash.

Only the last kind, the edges of repeated passages, is ever expanded into
single positions, with one representative of each entry. The order is that of
128-bit hashes of the entries rather than of their bytes; equal entries are
adjacent in either, and nothing else is asked of the order. Single strings are
compared by 88 bits, beside which a row has room for its chunk.

Texts are packed into compressed chunks once, and the table refers to chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.shingles import mix, powers
from framewright.session import reliable

LENGTH = 400
TRIGGER = 12
PHRASE = 48  # mean bytes of a phrase
# Farthest end of a phrase that judges a string, and bytes behind it that are compared first.
REACH = 280
FOLLOWING = LENGTH - REACH
CHUNK_BYTES = 2 << 20
# Bits of a string's second hash, and of a chunk's place in its task.
HASH_BITS, AT_BITS = 24, 19
# Rows of one group kept while its end is not in sight; longer groups are treated as mixed.
HELD_ROWS = 200_000

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_RNG = np.random.default_rng(5)
_BYTES = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in _BASES]
_SMALL = np.uint64((1 << 64) // PHRASE)


class Sums:
    """Prefix sums that give a 64-bit hash of any stretch of a buffer."""

    def __init__(self, a: np.ndarray, which: int):
        self.which, self.n = which, len(a) + 1
        self.sums = np.zeros(self.n, dtype=np.uint64)
        np.cumsum(_BYTES[which][a] * powers(_BASES[which], len(a)), out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        scale = powers(_INVERSES[self.which], self.n)
        return mix((self.sums[end] - self.sums[start]) * scale[start])


class Piece:
    """Entries of some segments of texts that lie one after the other in a buffer.

    Segments: begin, end of the starts it owns, end of its bytes. A text longer than
    a piece has several, each with enough bytes behind to judge its own starts.
    """

    def __init__(self, buffer: bytes, segments: np.ndarray):
        a = np.frombuffer(buffer, dtype=np.uint8)
        begin, own, end = segments.T
        self.sums = Sums(a, 0)
        self.more: Sums | None = None
        self.bytes = a
        spots = np.arange(TRIGGER, len(a) + 1)
        cut = spots[self.sums.of(spots - TRIGGER, spots) < _SMALL]
        seg = np.searchsorted(end, cut, side="left")  # segment whose bytes end at or after the cut
        inside = (seg < len(end)) & (cut - TRIGGER >= begin[np.minimum(seg, len(end) - 1)])
        cut, seg = cut[inside], seg[inside]
        low = np.maximum(begin[seg], cut - REACH)
        same = np.zeros(len(cut), dtype=bool)
        same[1:] = seg[1:] == seg[:-1]
        before = np.where(same, np.concatenate([[0], cut[:-1]]) - TRIGGER + 1, 0)
        low = np.maximum(low, before)
        high = np.minimum(np.minimum(cut - TRIGGER, end[seg] - LENGTH), own[seg] - 1)
        some = low <= high
        self.low, self.high, cut = low[some], high[some], cut[some]
        self.following = self.sums.of(cut - TRIGGER, cut + FOLLOWING)
        place = (cut - self.low).astype(np.uint64) << np.uint64(32)
        place |= (self.high - self.low).astype(np.uint64)
        self.entry = mix(self.sums.of(self.low, self.high + LENGTH) + mix(place))
        covered = np.zeros(len(a) + 1, dtype=np.int32)
        np.add.at(covered, self.low, 1)
        np.add.at(covered, self.high + 1, -1)
        starts = np.zeros(len(a) + 1, dtype=np.int32)
        last = np.minimum(own, end - LENGTH + 1)
        real = last > begin
        np.add.at(starts, begin[real], 1)
        np.add.at(starts, last[real], -1)
        self.gaps = np.flatnonzero((np.cumsum(starts) > 0) & (np.cumsum(covered) == 0))

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Positions of the strings that start in the chosen entries."""
        low, n = self.low[chosen], self.high[chosen] - self.low[chosen] + 1
        return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)

    def strings(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.more is None:
            self.more = Sums(self.bytes, 1)
        return self.sums.of(starts, starts + LENGTH), self.more.of(starts, starts + LENGTH)


def pieces(texts: list[bytes]) -> Iterator[tuple[Piece, list[tuple[int, int, int]]]]:
    """Pieces of about CHUNK_BYTES with (text number, place in the text, begin) of their segments."""
    spare = REACH + LENGTH + TRIGGER
    parts, segments, names, held = [], [], [], 0

    def made():
        return Piece(b"".join(parts), np.array(segments, dtype=np.int64)), list(names)

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK_BYTES):
            own = min(CHUNK_BYTES, len(text) - at)
            part = text[at : at + own + spare]
            parts.append(part)
            segments.append((held, held + own, held + len(part)))
            names.append((number, at, held))
            held += len(part)
            if held >= CHUNK_BYTES:
                yield made()
                parts, segments, names, held = [], [], [], 0
    if parts:
        yield made()


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=3)
    ids, texts, held = [], [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 33) + at], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([squeeze.compress(b"".join(texts))], pa.binary()),
            ],
            names=["chunk", "ids", "sizes", "packed"],
        )

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(key.as_py())
            texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held >= CHUNK_BYTES:
                yield row()
                ids, texts, held, at = [], [], 0, at + 1
    if ids:
        yield row()


def _unpack(sizes: list[int], packed: bytes) -> list[bytes]:
    flat = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(sum(sizes), 1))
    ends = np.cumsum([0, *sizes]).tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _once(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of 64-bit columns in their order, and whether each stood more than once."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order))) > 1


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = [(p.following, p.entry) for p, _ in pieces(_unpack(row["sizes"], row["packed"]))]
            if found:
                (y, x), many = _once(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [_long(y), _long(x), pa.array(np.full(len(y), row["chunk"])), pa.array(many)],
                    names=["y", "x", "chunk", "many"],
                )


def judge(y: np.ndarray, x: np.ndarray, many: np.ndarray, cut_first: bool, cut_last: bool) -> np.ndarray:
    """Of sorted entries: 1 repeated as a whole, 2 to be compared string by string, 3 both.

    A first or last group that may go on outside counts as one with other entries.
    """
    new_y = np.append(True, y[1:] != y[:-1])
    new_x = new_y | np.append(True, x[1:] != x[:-1])
    y_of, x_of = np.cumsum(new_y) - 1, np.cumsum(new_x) - 1
    kinds = np.bincount(y_of[new_x])
    mixed = kinds > 1
    if cut_first:
        mixed[0] = True
    if cut_last:
        mixed[-1] = True
    repeated = (np.bincount(x_of) > 1) | (np.bincount(x_of, weights=many) > 0)
    return repeated[x_of].astype(np.int32) + 2 * (new_x & mixed[y_of])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge sorted entries as they stream by; the group in sight is carried on."""
    held: list[np.ndarray] | None = None
    cut = True

    def out(columns: list[np.ndarray], cut_last: bool) -> pa.RecordBatch:
        y, x, chunk, many = columns
        kind = judge(y, x, many, cut, cut_last)
        keep = kind > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk[keep]), pa.array(x[keep]), pa.array(kind[keep], pa.int32())], names=["chunk", "x", "kind"]
        )

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        y = columns[0]
        last = int(np.searchsorted(y, y[-1], side="left"))
        if len(y) - last > HELD_ROWS:
            yield out(columns, True)
            held, cut = None, True
            continue
        if last:
            yield out([c[:last] for c in columns], False)
            cut = False
        held = [c[last:] for c in columns]
    if held is not None:
        yield out(held, True)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of the entries to be compared, and of starts that no phrase end is near."""
    for batch in batches:
        for row in batch.to_pylist():
            wanted = np.array(row["compared"] or [], dtype=np.int64).view(np.uint64)
            found = []
            for piece, _ in pieces(_unpack(row["sizes"], row["packed"])):
                entry, first = np.unique(piece.entry, return_index=True)
                starts = piece.starts(first[np.isin(entry, wanted)])
                # Entries that stand twice are repeated as a whole: one of them is enough.
                found.append(piece.strings(np.concatenate([starts, piece.gaps])))
            if found:
                (s, t), many = _once(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([_long(s), _long(with_place(t, row["chunk"], many))], names=["s", "rest"])


def with_place(t: np.ndarray, chunk: int, many: np.ndarray) -> np.ndarray:
    """The highest HASH_BITS of a hash, the chunk's number and a mark, in one number: rows of strings stay short."""
    part, at = chunk >> 33, chunk & ((1 << 33) - 1)
    if part >> (63 - HASH_BITS - AT_BITS) or at >> AT_BITS:
        raise ValueError("too many chunks")
    low = np.uint64(64 - HASH_BITS)
    return (t >> low << low) | np.uint64((part << AT_BITS | at) << 1) | many.astype(np.uint64)


def place_of(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, the chunks and the marks of ``with_place``."""
    low = np.uint64(64 - HASH_BITS)
    number = ((rest & np.uint64((1 << (64 - HASH_BITS)) - 1)) >> np.uint64(1)).view(np.int64)
    chunk = (number >> AT_BITS << 33) + (number & ((1 << AT_BITS) - 1))
    return rest >> low, chunk, rest & np.uint64(1) == 1


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, s) of sorted strings that stand in two chunks, or twice in one."""
    carry: list[np.ndarray] | None = None  # the last row before the batch
    carry_out = False
    for batch in batches:
        s, rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(s):
            continue
        t, chunk, many = place_of(rest.view(np.uint64))
        if carry is not None:
            s, t, chunk, many = (np.concatenate(c) for c in zip(carry, (s, t, chunk, many), strict=True))
        same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
        hit = many.copy()
        hit[1:] |= same
        hit[:-1] |= same
        if carry is not None and carry_out:
            hit[0] = False  # already given
        carry_out = bool(hit[-1]) or (carry_out and len(s) == 1)
        carry = [c[-1:] for c in (s, t, chunk, many)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[hit]), pa.array(s[hit])], names=["chunk", "s"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            texts = _unpack(row["sizes"], row["packed"])
            whole, compared, strings = (
                np.array(row[c] or [], dtype=np.int64).view(np.uint64) for c in ("whole", "compared", "strings")
            )
            edge: dict[int, np.ndarray] = {}
            for piece, names in pieces(texts):
                all_in = np.isin(piece.entry, whole)
                some_in = np.isin(piece.entry, compared) & ~all_in
                single = np.concatenate([piece.starts(np.flatnonzero(some_in)), piece.gaps])
                single = single[np.isin(piece.sums.of(single, single + LENGTH), strings)]
                starts = np.concatenate([piece.starts(np.flatnonzero(all_in)), single])
                begins = np.array([b for _, _, b in names])
                of = np.searchsorted(begins, starts, side="right") - 1
                for seg in np.unique(of).tolist():
                    number, at, begin = names[seg]
                    if number not in edge:
                        edge[number] = np.zeros(len(texts[number]) + 1, dtype=np.int32)
                    own = starts[of == seg] - begin + at
                    edge[number][own] += 1
                    edge[number][own + LENGTH] -= 1
            rows = []
            for number, (key, text) in enumerate(zip(row["ids"], texts, strict=True)):
                removed = spans = 0
                kept = text
                if number in edge:
                    gone = np.cumsum(edge[number][:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                rows.append((key, len(text), removed, spans, kept))
            key, n, removed, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()), pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _remove(batches):
        digests = [hashlib.sha256(k.as_buffer()).hexdigest() for k in batch.column(4)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(digests, pa.string())],
            names=[*batch.schema.names[:4], "kept_sha256"],
        )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (``kept``) or their SHA-256.

    Every byte that lies in a string of LENGTH bytes which also starts elsewhere,
    in this text or another, is removed. A null text is empty; texts shorter
    than LENGTH lose nothing; rows that repeat a text lose all of it; null and
    repeated ids are kept as they are; an empty table gives no rows; other
    columns are ignored. A text over CHUNK_BYTES is parsed in overlapping
    segments, with the same result.
    """
    packed = reliable(
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
            _chunks, "chunk bigint, ids array<bigint>, sizes array<bigint>, packed binary"
        )
    )
    bare = packed.select("chunk", "sizes", "packed")
    entries = bare.mapInArrow(_entries, "y bigint, x bigint, chunk bigint, many boolean")
    # By range of both hashes: a phrase that very many texts share spreads over several tasks.
    ordered = entries.repartitionByRange("y", "x", "chunk").sortWithinPartitions("y", "x", "chunk")
    verdicts = (
        ordered.mapInArrow(_verdicts, "chunk bigint, x bigint, kind int")
        .groupBy("chunk")
        .agg(
            F.collect_list(F.when(F.col("kind").bitwiseAND(1) > 0, F.col("x"))).alias("whole"),
            F.collect_list(F.when(F.col("kind").bitwiseAND(2) > 0, F.col("x"))).alias("compared"),
        )
    )
    verdicts = reliable(verdicts)
    strings = (
        bare.join(verdicts.select("chunk", "compared"), "chunk", "left")
        .select("chunk", "sizes", "packed", "compared")
        .mapInArrow(_strings, "s bigint, rest bigint")
    )
    # A string stands once per chunk at most, so no key is hot.
    found = (
        strings.repartition("s")
        .sortWithinPartitions("s", "rest")
        .mapInArrow(_repeated, "chunk bigint, s bigint")
        .groupBy("chunk")
        .agg(F.collect_set("s").alias("strings"))
    )
    judged = packed.join(verdicts, "chunk", "left").join(reliable(found), "chunk", "left")
    judged = judged.select("ids", "sizes", "packed", "whole", "compared", "strings")
    head = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
    if digests:
        return judged.mapInArrow(_digested, head + "kept_sha256 string")
    return judged.mapInArrow(_remove, head + "kept binary")

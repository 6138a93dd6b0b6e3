"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of L bytes may occur in a document with at most e = EDIT_RATE * L
byte edits. Such an occurrence shares at least L - q + 1 - q * e q-grams with
the item, all on diagonals (document position minus item position) that lie
within e of each other. Shared q-grams are counted in diagonal bands of
width 2 (e + 1), one starting every e + 1 diagonals, so that any e + 1
neighbouring diagonals lie together in one band. Bands that reach the bound are
aligned inside the band; only alignments within the budget are reported.

Items are dealt into blocks of bounded size; each block is a read-only index
that every task scans its documents against. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import reliable

Q = 12
EDIT_RATE = 0.05
# Item bytes of one index block.
BLOCK_BYTES = 4 << 20
# Document bytes scanned at once.
SCAN_BYTES = 1 << 18
_FILTER_BITS = 22

# A-Z to lower case, blanks and zero bytes to a space: lengths and positions stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in (0, 9, 10, 11, 12, 13) else b for b in range(256)
)


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def _hashes(buffer: bytes) -> np.ndarray:
    """A 64-bit hash of the Q = 12 bytes that start at each position."""
    n = len(buffer) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    four = np.empty(len(buffer) - 3, dtype=np.uint32)
    for shift in range(4):
        view = np.frombuffer(buffer, dtype="<u4", count=(len(buffer) - shift) // 4, offset=shift)
        four[shift::4] = view
    wide = four.astype(np.uint64)
    mixed = wide[:n] * np.uint64(0x9E3779B97F4A7C15)
    mixed += wide[4 : n + 4] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += wide[8 : n + 8] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed


@dataclass
class Index:
    ids: list[int | None]
    items: list[bytes]
    keys: np.ndarray  # sorted q-gram hashes
    first: np.ndarray  # where the postings of each key begin
    item: np.ndarray  # postings: item number and position
    at: np.ndarray
    maybe: np.ndarray  # one flag for each value of the leading bits of a hash
    edits: np.ndarray  # budget and least shared q-grams of each item
    least: np.ndarray


def build_index(rows: list[tuple[int | None, str | None]], rate: float = EDIT_RATE) -> Index:
    """Index of one block. Items of fewer than Q bytes are left out, since they match anywhere."""
    kept = [(i, fold(t).strip()) for i, t in rows]
    kept = [(i, t) for i, t in kept if len(t) >= Q]
    hashes = [_hashes(t) for _, t in kept]
    number = np.repeat(np.arange(len(kept), dtype=np.int64), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h), dtype=np.int64) for h in hashes] or [np.zeros(0, np.int64)])
    flat = np.concatenate(hashes or [np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    lengths = np.array([len(t) for _, t in kept], dtype=np.int64)
    # The lemma bounds nothing where a budget would allow all q-grams to differ.
    edits = np.minimum((lengths * rate).astype(np.int64), np.maximum((lengths - Q) // Q, 0))
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    maybe[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(
        [i for i, _ in kept], [t for _, t in kept], keys, np.append(first, len(flat)),
        number[order], at[order], maybe, edits, np.maximum(lengths - Q + 1 - Q * edits, 1),
    )


def _ends(item: bytes, text: bytes, low: int, width: int, anywhere: bool = True) -> np.ndarray:
    """Least edits of the whole item against text ending at each place, within a band.

    Cell (i, k) stands for item prefix i and text position low + i + k;
    the alignment starts anywhere on the band, or else at the start of the text.
    """
    far = 1 << 20
    a = np.frombuffer(item, dtype=np.uint8)
    t = np.frombuffer(text, dtype=np.uint8)
    places = np.arange(width)
    starts = (low + places >= 0) & (low + places <= len(t)) if anywhere else low + places == 0
    row = np.minimum.accumulate(np.where(starts, 0, far) - places) + places
    for i in range(1, len(a) + 1):
        spots = low + i + places  # text prefix of each cell
        inside = (spots >= 0) & (spots <= len(t))
        letters = t[np.clip(spots - 1, 0, len(t) - 1)]
        diagonal = row + np.where(spots >= 1, letters != a[i - 1], far)
        above = np.append(row[1:], far) + 1
        best = np.where(inside, np.minimum(diagonal, above), far)
        row = np.minimum.accumulate(best - places) + places
        row = np.where(inside, row, far)
    return row


def align(item: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of the item near diagonals low..high."""
    left, right = max(0, low), min(len(text), high + len(item))
    exact = text.find(item, left, right)
    if exact >= 0:
        return exact, exact + len(item), 0
    if budget == 0 or not text:
        return None
    width = high - low + 1 + 2 * budget
    row = _ends(item, text, low - budget, width)
    k = int(row.argmin())
    edits = int(row[k])
    if edits > budget:
        return None
    end = low - budget + len(item) + k
    # The start is the end of the reversed item in the reversed text.
    back = _ends(item[::-1], text[:end][::-1], -budget, 2 * budget + 1, False)
    back_end = [len(item) - budget + j for j in range(len(back)) if back[j] == min(back)]
    start = max(0, end - min(back_end, key=lambda x: abs(x - len(item))))
    return start, end, edits


def scan(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of every occurrence."""
    pad = b"\0" * Q
    buffer = pad.join(texts)
    begin = np.cumsum([0] + [len(t) + Q for t in texts])
    hashes = _hashes(buffer)
    spots = np.flatnonzero(index.maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(spots) or not len(index.keys):
        return []
    found = np.searchsorted(index.keys, hashes[spots])
    found[found == len(index.keys)] = 0
    same = index.keys[found] == hashes[spots]
    spots, found = spots[same], found[same]
    counts = index.first[found + 1] - index.first[found]
    if not counts.sum():
        return []
    ends = np.cumsum(counts)
    posting = np.arange(ends[-1]) - np.repeat(ends - counts - index.first[found], counts)
    item = index.item[posting]
    number = np.repeat(np.searchsorted(begin, spots, side="right") - 1, counts)
    diagonal = np.repeat(spots, counts) - begin[number] - index.at[posting]
    step = index.edits[item] + 1
    # Negative diagonals occur where a text begins inside an item.
    band = np.floor_divide(diagonal, step)
    rows = np.concatenate(
        [np.stack([number, item, band]), np.stack([number, item, band - 1])], axis=1
    ).T
    bands, n = np.unique(rows, axis=0, return_counts=True)
    out = set()
    for text, i, b in bands[n >= index.least[bands[:, 1]]].tolist():
        width = int(index.edits[i]) + 1
        hit = align(index.items[i], texts[text], b * width, (b + 2) * width - 1, width - 1)
        if hit is not None:
            out.add((text, i, *hit))
    return _distinct(sorted(out))


def _distinct(hits: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping occurrences of one item in one text, the one with fewest edits."""
    out: list[tuple[int, int, int, int, int]] = []
    for hit in hits:
        if out and out[-1][:2] == hit[:2] and hit[2] < out[-1][3]:
            if hit[4] < out[-1][4]:
                out[-1] = hit
            continue
        out.append(hit)
    return out


def _slices(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about SCAN_BYTES, with the number of the first."""
    low, held, some = 0, 0, []
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= SCAN_BYTES:
            yield low, some
            low, held, some = low + len(some), 0, []
    if some:
        yield low, some


def _block_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Items with the number of their block, dealt by a hash, and how many blocks there are."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def _index(items: DataFrame, block: int, rate: float):
    """Broadcast index of one block of about ``block_bytes`` item bytes."""
    rows = [tuple(r) for r in items.filter(F.col("block") == block).drop("block").collect()]
    return items.sparkSession.sparkContext.broadcast(build_index(sorted(rows, key=str), rate))


_HITS = "doc_id bigint, item_id bigint, start bigint, n_bytes bigint, edits int"


def _find(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low, some in _slices(fold(t.as_py()) for t in batch.column(1)):
                for text, item, start, end, edits in scan(held.value, some):
                    rows.append((low + text, held.value.ids[item], start, end - start, edits))
            number, item, start, n, edits = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(number, pa.int64())),
                    pa.array(item, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(edits, pa.int32()),
                ],
                names=["doc_id", "item_id", "start", "n_bytes", "edits"],
            )

    return run


def find(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every occurrence of an item in a document: doc_id, item_id, start, n_bytes, edits.

    Places count bytes of the UTF-8 text. Case of A-Z and kind of blank do
    not count as edits. Null and short texts and items give no row; repeated
    rows of documents or items give repeated rows; other columns are ignored;
    an empty table on either side gives no rows. The index of one block of items
    is broadcast, its hits are written, and it is dropped before the next.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    items, blocks = _block_of(benchmark, block_bytes)
    out = None
    for block in range(blocks):
        held = _index(items, block, rate)
        hits = reliable(rows.mapInArrow(_find(held), _HITS))
        held.destroy()
        out = hits if out is None else out.unionAll(hits)
    return out


def _clean(held, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, some in _slices(fold(t.as_py()) for t in batch.column(at)):
                keep = np.ones(len(some), dtype=bool)
                for hit in scan(held.value, some):
                    keep[hit[0]] = False
                yield batch.slice(low, len(some)).filter(pa.array(keep))

    return run


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Pipeline stage: the documents in which no item occurs; columns unchanged.

    One index is held at a time: what is left after a block of items is written
    before the next block, but for the last.
    """
    at = docs.columns.index("text")
    items, blocks = _block_of(benchmark, block_bytes)
    for block in range(blocks):
        held = _index(items, block, rate)
        docs = docs.mapInArrow(_clean(held, at), docs.schema)
        if block < blocks - 1:
            docs = reliable(docs)
            held.destroy()
    return docs

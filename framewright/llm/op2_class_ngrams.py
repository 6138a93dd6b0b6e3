"""Scoring by a Brown class-based bigram model.

The most frequent words, the core, are put into classes by exchange
clustering: a word moves to the class that raises the likelihood of the class
bigrams most. Every other word of the training texts then takes its best class
by the same gain, from how often it stands before and after words of each
class; where its neighbour is outside the core, the class of that is not known
yet. The class bigrams of the model are counted over all words. A token then
costs the probability of its class after the class before it, smoothed with the
frequency of the class, times the probability of the word in its class. Only
words that training never saw have no class; they cost what they cost by count.

What is counted grows with the corpus and stays distributed: word counts and
the classes of words are tables; bigrams of single words are counted inside the
core, a table of at most CLUSTERED squared rows, and of other words with
classes. Frequent words with counts and classes, of bounded number and length,
are broadcast; those of all other words are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import fold_of
from framewright.session import reliable

# Words of the core, classes, and words whose counts are broadcast; longest such word in bytes.
CLUSTERED = 8_192
CLASSES = 64
KNOWN = 200_000
KNOWN_BYTES = 48
ROUNDS = 10
SMOOTHING = 20.0
# Bytes of texts whose words are counted together, and whose rows are made together.
HELD_BYTES, CODED_BYTES = 8 << 20, 4 << 20
BLOCK = 1_024
# Words that are placed together, and counts whose gains are looked up.
PLACED, SMALL = 512, 4


def held_rows(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``most`` bytes of texts (a row counts 16 bytes more); a longer text ends its run."""
    held: list[pa.RecordBatch] = []
    left = most
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64) + 16)
        at = before = 0
        while at < batch.num_rows:
            n = min(int(np.searchsorted(ends, before + left)) + 1, batch.num_rows) - at
            held.append(batch.slice(at, n))
            at += n
            left, before = left - int(ends[at - 1]) + before, int(ends[at - 1])
            if left <= 0:
                yield pa.concat_batches(held)
                held, left = [], most
    if held:
        yield pa.concat_batches(held)


@dataclass
class Tokens:
    """Words of some texts as numbers of their distinct words, which may hold one that is empty and not used.

    In a line of all tokens with an edge before and behind each text, ``spot`` is where each
    token stands; text i reaches from ``edges[i] + 2 * i`` up to the next.
    """

    distinct: pa.Array
    word: np.ndarray
    edges: np.ndarray  # of the texts, in tokens
    text: np.ndarray  # of each token
    spot: np.ndarray

    @property
    def line(self) -> int:
        return len(self.word) + 2 * (len(self.edges) - 1)


def tokens_of(texts: pa.Array) -> Tokens:
    """Arrow lowers exactly A-Z and splits on exactly the six blanks that end a word."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    edges = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.dictionary_encode()
    word = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()  # before and behind blanks at the ends of a text
    if empty >= 0:
        full = word != empty
        word, edges = word[full], np.append(0, np.cumsum(full))[edges]
    text = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
    spot = np.arange(1, len(word) + 1, dtype=np.int32) + 2 * text
    return Tokens(coded.dictionary.cast(pa.binary()), word, edges, text, spot)


def _numbers(t: Tokens, of: pa.Array) -> np.ndarray:
    """Place of each token's word in ``of``; its length for others."""
    found = pc.index_in(t.distinct, value_set=of)
    return found.fill_null(len(of)).to_numpy()[t.word]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in held_rows(batches, 0, HELD_BYTES):
        t = tokens_of(some.column(0))
        n = np.bincount(t.word, minlength=len(t.distinct))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [t.distinct.take(pa.array(used)), pa.array(n[used], pa.int64())], names=["word", "n"]
        )


def _count_pairs(held):
    """Bigrams of word numbers as first * (size + 2) + second; see ``Numbers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = pa.array(list(held.value), pa.binary())
        size = len(core)
        edge = size + 1
        for some in held_rows(batches, 0, HELD_BYTES):
            t = tokens_of(some.column(0))
            line = np.full(t.line, edge, dtype=np.int64)
            line[t.spot] = _numbers(t, core)
            # The last edge of a text makes no pair with the first of the next.
            last = t.edges[1:-1] + 2 * np.arange(1, len(t.edges) - 1) - 1
            pairs, n = np.unique(np.delete(line[:-1] * (size + 2) + line[1:], last), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigram counts, up to the part classes do not change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def best_class(
    table: np.ndarray, after: np.ndarray, before: np.ndarray, own: float, home: int, open_: int
) -> int:
    """The class among the first ``open_`` into which a word fits best.

    ``table``: class bigram counts with the word at ``home``. ``after`` and
    ``before``: how often the word precedes and follows each class, itself
    excluded; ``own``: how often it follows itself.
    """
    t = table.copy()
    t[home] -= after
    t[:, home] -= before
    t[home, home] -= own
    # What stands before and after the word counts for other classes wherever it goes.
    rows, columns, corner = t.sum(axis=1) + before, t.sum(axis=0) + after, np.diag(t)
    gain = (_xlogx(t + after[None, :]) - _xlogx(t)).sum(axis=1)
    gain += (_xlogx(t + before[:, None]) - _xlogx(t)).sum(axis=0)
    gain += (
        _xlogx(corner + after + before + own) - _xlogx(corner + after)
        - _xlogx(corner + before) + _xlogx(corner)
    )
    gain -= _xlogx(rows + after.sum() + own) - _xlogx(rows)
    gain -= _xlogx(columns + before.sum() + own) - _xlogx(columns)
    best = int(gain[:open_].argmax())
    return best if gain[best] > gain[home] + 1e-9 else home


def _profiles(held, size: int, classes: int):
    """Per block of words: counts of the words before and after each class, and self pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        width = classes + 2
        sums = np.zeros((size, 2 * width + 1), dtype=np.int64)
        seen = False
        for batch in batches:
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = pair // (size + 2), pair % (size + 2)
            seen = seen or len(pair) > 0
            same = a == b
            first = (a < size) & ~same
            np.add.at(sums, (a[first], of[b[first]]), n[first])
            second = (b < size) & ~same
            np.add.at(sums, (b[second], width + of[a[second]]), n[second])
            self_ = same & (a < size)
            np.add.at(sums, (a[self_], np.full(self_.sum(), 2 * width)), n[self_])
        if seen:
            for low in range(0, size, BLOCK):
                yield pa.RecordBatch.from_pydict(
                    {"block": [low], "sums": [sums[low : low + BLOCK].astype("<i8").tobytes()]}
                )

    return run


def _moves(table: np.ndarray, of: np.ndarray, classes: int, turn: int):
    width = classes + 2

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0])
        sums = sum(np.frombuffer(x, dtype="<i8").reshape(-1, 2 * width + 1) for x in rows["sums"])
        out = []
        for i, row in enumerate(sums.astype(np.float64)):
            word = low + i
            home = int(of[word])
            if (word * 2654435761 >> 7) % 2 == turn % 2:  # half of the words at a time
                home = best_class(
                    table, row[:width], row[width : 2 * width], row[2 * width], home, classes
                )
            out.append((word, home))
        return pd.DataFrame(out, columns=["word", "class"])

    return run


def _table(pairs: DataFrame, held, size: int, classes: int) -> np.ndarray:
    """Class bigram counts, (classes + 2) squared numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, width = held.value, classes + 2
        sums = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            np.add.at(sums, of[pair // (size + 2)] * width + of[pair % (size + 2)], n)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], names=["cell", "n"])

    rows = pairs.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((classes + 2) ** 2)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(classes + 2, classes + 2)


def exchange(pairs: DataFrame, size: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word number (two more for other words and for text edges), and bigram counts.

    Words begin dealt over the classes by frequency. In each round half of the
    words choose their best class at once; a round that does not raise the
    likelihood is not taken.
    """
    spark = pairs.sparkSession
    share = spark.sparkContext.broadcast
    of = np.append(np.arange(size) % classes, [classes, classes + 1]).astype(np.int64)
    table = _table(pairs, share(of), size, classes)
    best = likelihood(table)
    idle = 0
    for turn in range(rounds):
        moved = (
            pairs.mapInArrow(_profiles(share(of), size, classes), "block bigint, sums binary")
            .groupBy("block")
            .applyInPandas(_moves(table, of, classes, turn), "word bigint, class bigint")
            .collect()
        )
        new = of.copy()
        for r in moved:
            new[r[0]] = r[1]
        new_table = _table(pairs, share(new), size, classes)
        value = likelihood(new_table)
        idle = 0 if value > best else idle + 1
        if value > best:
            of, table, best = new, new_table, value
        if idle == 2:
            break
    return of, table


def _contexts(held, classes: int):
    """Per word outside the core: n * cells + cell, for cells as in ``_profiles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of = held.value
        core, width = pa.array(list(number), pa.binary()), classes + 2
        cells, other = 2 * width + 1, len(core)
        for some in held_rows(batches, 0, HELD_BYTES):
            t = tokens_of(some.column(0))
            found = _numbers(t, core)
            cls = np.full(t.line, of[other + 1], dtype=np.int32)
            cls[t.spot] = of[found]
            word = np.full(t.line, -1, dtype=np.int32)
            at, here = t.spot[found == other], t.word[found == other].astype(np.int64)
            word[at] = here
            after = here * cells + np.where(word[at + 1] == here, 2 * width, cls[at + 1])
            before = (here * cells + width + cls[at - 1])[word[at - 1] != here]
            found, n = np.unique(np.concatenate([after, before]), return_counts=True)
            word = found // cells
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, dtype=np.int64)
            offsets = np.append(starts, len(found)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [t.distinct.take(pa.array(word[starts])), pa.ListArray.from_arrays(offsets, n * cells + found % cells)],
                names=["word", "cells"],
            )

    return run


def _delta(by_class: np.ndarray, open_: int) -> np.ndarray:
    """xlogx(t + n) - xlogx(t) for n up to SMALL, for each context and class."""
    t = by_class[None, :, :open_]
    return _xlogx(t + np.arange(SMALL + 1)[:, None, None]) - _xlogx(t)


def _add_rows(gain: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """np.add.at for ascending places."""
    if len(at):
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        gain[at[starts]] += np.add.reduceat(rows, starts, axis=0)


def place(table: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray, size: int, open_: int) -> np.ndarray:
    """Class among the first ``open_`` into which each of ``size`` words of class ``open_`` fits best.

    The gain is that of ``best_class``, for sparse profiles: ``n`` times ``word``
    has ``cell``, as in ``_profiles``.
    """
    width, home = len(table), open_
    after, before, own = np.zeros((size, width)), np.zeros((size, width)), np.zeros((size, 1))
    is_after, is_before = cell < width, (cell >= width) & (cell < 2 * width)
    after[word[is_after], cell[is_after]] = n[is_after]
    before[word[is_before], cell[is_before] - width] = n[is_before]
    own[word[cell == 2 * width], 0] = n[cell == 2 * width]
    gain = np.zeros((size, open_))
    for counts, other, by_class in ((after, before, table.T), (before, after, table)):
        at, context = np.nonzero(counts)
        times = counts[at, context]
        rows = _delta(by_class, open_)[np.minimum(times, SMALL).astype(np.int64), context]
        rest = np.flatnonzero((context == home) | (times > SMALL))
        t = by_class[context[rest], :open_]
        t[context[rest] == home] -= other[at[rest][context[rest] == home], :open_]
        rows[rest] = _xlogx(t + times[rest][:, None]) - _xlogx(t)
        _add_rows(gain, at, rows)
        total, all_ = by_class.sum(axis=0)[:open_], counts.sum(axis=1) + own[:, 0]
        all_, of = np.unique(all_, return_inverse=True)
        gain -= (_xlogx(total + all_[:, None]) - _xlogx(total))[of]
    at, to = np.nonzero(((after > 0) & (before > 0) | (own > 0))[:, :open_])
    corner, a, b, o = np.diag(table)[to], after[at, to], before[at, to], own[at, 0]
    gain[at, to] += _xlogx(corner + a + b + o) - _xlogx(corner + a) - _xlogx(corner + b) + _xlogx(corner)
    return gain.argmax(axis=1)


def _placed(held, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = held.value, classes + 2
        for batch in batches:
            for low in range(0, batch.num_rows, PLACED):
                some = batch.slice(low, PLACED)
                profile = some.column(1)
                size = some.num_rows
                word = np.repeat(np.arange(size), profile.value_lengths().to_numpy())
                cell, n = (c.to_numpy(zero_copy_only=False) for c in profile.flatten().flatten())
                # Each occurrence has one token before it, itself or another.
                seen = np.bincount(word, np.where(cell >= width, n, 0), size).astype(np.int64)
                found = place(table, word, cell, n.astype(np.float64), size, classes)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(seen), pa.array(found, pa.int32())], names=["word", "n", "class"]
                )

    return run


def others(texts: DataFrame, number: dict[bytes, int], of: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """(word, n, class) of every word of the texts outside the core."""
    share = texts.sparkSession.sparkContext.broadcast
    cells = 2 * (classes + 2) + 1
    profiles = (
        texts.mapInArrow(_contexts(share((number, of)), classes), "word binary, cells array<bigint>")
        .repartition("word")
        .select("word", F.explode("cells").alias("c"))
        .groupBy("word", (F.col("c") % cells).cast("int").alias("cell"))
        .agg(F.sum(F.floor(F.col("c") / cells)).alias("n"))
        .groupBy("word")
        .agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("profile"))
    )
    return profiles.mapInArrow(_placed(share(table), classes), "word binary, n bigint, class int")


@dataclass
class Words:
    number: dict[bytes, int]
    base: np.ndarray  # log10 of the base probability of each word that is broadcast
    of: np.ndarray  # its class
    log: np.ndarray  # log10 of its count
    end: float  # log10 of the base probability of the end
    ends: int
    whole: float  # what base probabilities are divided by
    tail: int
    edge: int


def _code(tail: int) -> type:
    return np.uint8 if tail < 255 else np.uint16


def _coded(held):
    """Rows with the class of each token, and the words for which it is still to be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Words = held.value
        known, part, first_row = pa.array(list(m.number), pa.binary()), TaskContext.get().partitionId(), 0
        for some in held_rows(batches, 2, CODED_BYTES):
            t = tokens_of(some.column(2))
            size, found = some.num_rows, _numbers(t, known)
            is_known = found < len(known)
            own = found[is_known]
            ends = np.append(0, np.cumsum(is_known))[t.edges]
            codes = np.full(t.line, m.edge, dtype=_code(m.tail))
            codes[t.spot] = m.tail
            codes[t.spot[is_known]] = m.of[own]
            # Each text's other words, numbered inside the text.
            rest, which = np.unique(
                t.text[~is_known].astype(np.int64) * len(t.distinct) + t.word[~is_known], return_inverse=True
            )
            rest_ends = np.searchsorted(rest, np.arange(size + 1) * len(t.distinct))
            k = np.arange(len(rest)) - np.repeat(rest_ends[:-1], np.diff(rest_ends))
            words = t.distinct.take(pa.array(rest % max(len(t.distinct), 1)))
            pairs = pa.StructArray.from_arrays([pa.array(k, pa.int32()), words], ["k", "word"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((part << 33) + first_row + np.arange(size)), *some.columns[:2],
                    pa.array(np.diff(t.edges) + 1), pa.array(np.diff(ends) + (1 if m.ends else 0)),
                    pa.array(_sums(m.base[own], ends) + m.end), pa.array(_sums(m.log[own], ends)),
                    _binary(codes, t.edges + 2 * np.arange(size + 1)),
                    _binary(k[which].astype("<i4"), t.edges - ends),
                    pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), pairs),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "log", "codes", "which", "rest"],
            )
            first_row += size

    return run


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.array([values[a:b].sum() for a, b in pairwise(ends.tolist())])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the values between two ends, for each."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _completed(tail: int, whole: float):
    """Fill in the counts and classes that were joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_known, base, log = (batch.column(i).to_numpy().copy() for i in (3, 4, 5))
            out = batch.column(6).to_pylist()
            which, found = batch.column(7), batch.column(8)
            for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
                k, c, cls = (x.to_numpy(zero_copy_only=False) for x in found[i].values.flatten())
                count, of = np.zeros(len(k)), np.full(len(k), tail)
                count[k], of[k] = c, cls
                token = np.frombuffer(which[i].as_py(), dtype="<i4")
                n = count[token]
                codes = np.frombuffer(out[i], dtype=_code(tail)).copy()
                codes[codes == tail] = of[token]
                out[i] = codes.tobytes()
                n_known[i] += (n > 0).sum()
                base[i] += np.log10((n + 0.5) / whole).sum()
                log[i] += np.log10(np.maximum(n, 1)).sum()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(n_known), pa.array(base), pa.array(log),
                    pa.array(out, pa.binary()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "log", "codes"],
            )

    return run


def _class_pairs(tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tail + 2
        sums = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for codes in batch.column(0):
                c = np.frombuffer(codes.as_buffer(), dtype=_code(tail)).astype(np.int64)
                np.add.at(sums, c[:-1] * width + c[1:], 1)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], names=["cell", "n"])

    return run


def _scored(held, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = held.value
        for batch in batches:
            score = batch.column(5).to_numpy().copy()
            for i, codes in enumerate(batch.column(6)):
                c = np.frombuffer(codes.as_buffer(), dtype=_code(tail))
                score[i] += step[c[:-1], c[1:]].sum()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def steps(table: np.ndarray, unseen: float) -> np.ndarray:
    """log10 of the probability of a class after a class, less log10 of the count of the second class.

    With the log10 of the count of a word this is what the word costs. The last
    but one class holds words never seen in training; it comes after any class
    with the chance ``unseen``.
    """
    tail = len(table) - 2
    seen = table.sum(axis=0)
    frequency = np.delete(seen, tail) + 0.5
    smooth = np.insert(SMOOTHING * frequency / frequency.sum(), tail, 0.0)
    step = (1 - unseen) * (table + smooth) / (table.sum(axis=1, keepdims=True) + SMOOTHING)
    step[:, tail] = unseen
    count = np.maximum(seen, 1)
    count[-1] = 1
    return np.log10(step) - np.log10(count)


def train(
    docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, known: int = KNOWN
) -> tuple[Words, DataFrame, int]:
    """Words that are broadcast, the table (word, n, class) of all others, and the number of tokens."""
    spark = docs.sparkSession
    texts = docs.select("text")
    counted = reliable(
        texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    )
    sums = counted.agg(F.sum("n"), F.count("*")).first()
    ends = texts.count()
    band = F.floor(F.log2("n") * 32).cast("int")
    short = F.octet_length("word") <= KNOWN_BYTES
    bands = sorted(counted.filter(short).groupBy(band.alias("band")).count().collect(), reverse=True)
    # The words of the highest bands of frequency that together are no more than ``known``,
    # and the bands that hold the core.
    left, least = known, 1 << 30
    for r in bands:
        left -= r["count"]
        if left < 0:
            break
        least = r["band"]
    need, core_least = clustered, 1 << 30
    for r in bands:
        if need <= 0:
            break
        need, core_least = need - r["count"], r["band"]
    core = (
        counted.filter(short & (band >= core_least)).orderBy(F.desc("n"), "word").limit(clustered).collect()
    )
    size = len(core)
    number = {bytes(r["word"]): i for i, r in enumerate(core)}
    classes = max(1, min(classes, size))
    held = spark.sparkContext.broadcast(number)
    pairs = reliable(
        texts.mapInArrow(_count_pairs(held), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    )
    of, table = exchange(pairs, size, classes)
    more = reliable(others(texts, number, of, table, classes))
    is_known = short & (band >= least)
    top = more.filter(is_known).collect()
    number = {**number, **{bytes(r["word"]): size + i for i, r in enumerate(top)}}
    n = np.array([r["n"] for r in [*core, *top]], dtype=np.float64)
    class_of = np.append(of[:size], [r["class"] for r in top]).astype(np.int64)
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (1 if ends else 0)
    whole = tokens + 0.5 * (distinct + 1)
    held_words = Words(
        number, np.log10((n + 0.5) / whole), class_of, np.log10(n), float(np.log10((ends + 0.5) / whole)),
        ends, whole, classes, classes + 1,
    )
    return held_words, more.filter(~is_known), tokens


def held_out(id_col: str = "doc_id"):
    """True for documents that training never sees; a null id is a training row."""
    return F.coalesce(fold_of(F.col(id_col), 5) == 1, F.lit(False))


def score(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity per row.

    A null or blank text is the end token alone. Repeated rows are scored
    alike, null ids too; an empty table gives no rows; without any training
    row every word is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text"))
    model, more, tokens = train(own.filter("not held_out"), **sizes)
    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = reliable(
        own.mapInArrow(
            _coded(spark.sparkContext.broadcast(model)),
            f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, "
            "log double, codes binary, which binary, rest array<struct<k:int,word:binary>>",
        )
    )
    found = (
        rows.select("row", F.explode("rest").alias("r"))
        .select("row", F.col("r.k").alias("k"), F.col("r.word").alias("word"))
        .join(more, "word", "left")
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct(
                    "k", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("class", F.lit(model.tail)).alias("class"),
                )
            ).alias("found")
        )
    )
    fields = ["doc_id", "held_out", "n_tokens", "n_known", "base", "log", "codes"]
    whole_rows = reliable(
        rows.drop("rest").join(found, "row", "left").select(*fields, "which", "found").mapInArrow(
            _completed(model.tail, model.whole),
            f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, log double, "
            "codes binary",
        )
    )
    cells = (
        whole_rows.filter("not held_out").select("codes")
        .mapInArrow(_class_pairs(model.tail), "cell bigint, n bigint")
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    table = np.zeros((model.tail + 2) ** 2)
    for r in cells:
        table[r["cell"]] = r["n"]
    step = steps(table.reshape(model.tail + 2, -1), min(0.5 / model.whole, 0.5))
    scored = whole_rows.select(*fields).mapInArrow(
        _scored(spark.sparkContext.broadcast(step), model.tail),
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

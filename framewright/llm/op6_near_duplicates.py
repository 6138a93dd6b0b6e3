"""Near duplicates by SetSketch registers, banding, joint likelihood and exact check.

Texts with equal shingle sets are one class. A class has a SetSketch: register i
holds the exponentially distributed minimum of hash function i over the set,
truncated to a power of the base, so that sketches merge by maximum and
registers agree about as often as the sets overlap. Classes that agree on all
registers of a band meet in a bucket. Of a pair that meets, the number of
registers that are larger, smaller and equal gives the maximum-likelihood
estimate of the similarity, given both set sizes; pairs far below the threshold
go. The others are confirmed on the full sets.

No group is expanded into its pairs. Every bucket links its members to one, the
most central, and what is left to the most central of the rest. Members that
still lie in different components are compared only where they can be similar:
let p be the central member and y one that isn't linked to it. A set x can reach
the threshold with y only if it shares shingles with y outside p, since what
y shares with p is too little, or if x is smaller than p by enough. So pairs are
found by their differences from p, cut to prefixes by the number of differences
that must agree, and no others need a look. With BANDS bands of ROWS registers a
pair exactly at similarity 0.8 never meets with a chance of 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import components
from framewright.llm.shingles import mix, shingle_set, slices, word_hashes
from framewright.operators.lookups import lookup_join
from framewright.session import reliable

BANDS, ROWS = 60, 6
BASE = 1.001
# Registers used by the estimate, and how far below the threshold it may lie.
JUDGED, SLACK = 128, 0.25
# Rounds in which what a centre has left unlinked is linked to the most central of it.
STAR_ROUNDS = 1

_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def registers(found: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes: uint16, larger for smaller minima."""
    least = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    short = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for low in range(0, len(short), 64):
        block = short[low : low + 64, None] * _A[None, :]
        block += _B[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    spread = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(spread) / np.log(BASE)) + 3_500, 0, 65_535).astype("<u2")


def likely(plus: np.ndarray, minus: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood, from how many registers are larger and smaller."""
    grid = np.linspace(0, 1, 101)
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = grid[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9)

    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-9)
    plus, minus = plus[:, None], minus[:, None]
    log = plus * np.log(up) + minus * np.log(down) + (JUDGED - plus - minus) * np.log(same)
    return j[np.arange(len(j)), log.argmax(axis=1)]


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(t.as_py() for t in batch.column(1)):
                sets = [shingle_set(w, k) for w in word_hashes(some)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(some)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(
                            [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets],
                            pa.binary(),
                        ),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "print", "sketch"],
                )
                at += len(some)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            flat = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2")
            rows = flat.reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(salt, rows.shape[:2]).copy()
            for i in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
            nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["key", "node"]
            )


def _judge(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                left, right = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), dtype="<u2").reshape(-1, JUDGED)
                    for c in (2, 3)
                )
                n_a, n_b = (part.column(c).to_numpy().astype(float) for c in (4, 5))
                found = likely((left > right).sum(axis=1), (left < right).sum(axis=1), n_a, n_b)
                near = pa.array(found >= threshold / 100 - SLACK)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(near), part.column(1).filter(near)], names=["a", "b"]
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(t.as_py() for t in batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(some)),
                        pa.array([shingle_set(w, k).tobytes() for w in word_hashes(some)], pa.binary()),
                    ],
                    names=["node", "members"],
                )
                at += len(some)

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), dtype=np.uint64) for c in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            near = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"]
            )

    return run


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of distinct pairs of classes, those at or above the threshold, written once."""

    def side(frame: DataFrame, name: str, *columns) -> DataFrame:
        return frame.select(F.col("node").alias(name), *columns)

    head = F.substring("sketch", 1, 2 * JUDGED)
    sized = (
        pairs.join(side(classes, "a", head.alias("s_a"), F.col("n").alias("n_a")), "a")
        .join(side(classes, "b", head.alias("s_b"), F.col("n").alias("n_b")), "b")
        .filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    )
    near = reliable(
        sized.select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(_judge(threshold), "a bigint, b bigint")
    )
    full = (
        near.join(side(sets, "a", F.col("members").alias("m_a")), "a")
        .join(side(sets, "b", F.col("members").alias("m_b")), "b")
        .select("a", "b", "m_a", "m_b")
    )
    return reliable(full.mapInArrow(_confirm(threshold), "a bigint, b bigint"))


def _labels(links: DataFrame, weight: DataFrame) -> DataFrame:
    """(node, root): a linked node near every linked node; equal roots are surely connected.

    The root is the most central linked node, followed twice. That merges what
    hangs on a centre at a fraction of the cost of components, which are only
    needed once, at the end.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rank = F.struct("weight", -F.col("b"))
    step = (
        both.unionAll(both.select("a", F.col("a").alias("b")).distinct())
        .join(weight.select(F.col("node").alias("b"), "weight"), "b")
        .groupBy("a")
        .agg(F.max_by("b", rank).alias("root"))
        .withColumnRenamed("a", "node")
    )
    step = reliable(step)
    for _ in range(2):
        ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = step.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return reliable(step)


def _rooted(pairs: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
    """The pairs with the component of one side; nodes without links are their own."""
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = pairs.join(named, F.col(name) == F.col("_node"), "left")
    return joined.withColumn(root, F.coalesce("_root", name)).drop("_node", "_root")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(centre, node, root, centre_root) of buckets of three or more in several components."""
    rows = _rooted(_rooted(buckets, roots, "node", "root"), roots, "centre", "centre_root")
    open_ = (
        rows.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
        .filter("low <> high and size > 2")
        .select("key")
    )
    return rows.join(open_, "key").select("centre", "node", "root", "centre_root").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, tokens = [], []
        for own, centre in zip(batch.column(4), batch.column(5), strict=True):
            x, c = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (own, centre))
            outside = x[~np.isin(x, c, assume_unique=True)]
            shared.append(len(x) - len(outside))
            tokens.append(outside.view(np.int64))
        sizes = [len(v.as_buffer()) // 8 for v in batch.column(4)]
        centres = [len(v.as_buffer()) // 8 for v in batch.column(5)]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(centres, pa.int64()),
                pa.array(shared, pa.int64()), pa.array(tokens, pa.list_(pa.int64())),
            ],
            names=["centre", "node", "root", "centre_root", "n", "n_centre", "shared", "tokens"],
        )


def _by_differences(mixed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold, by centre.

    a is not linked to the centre. For similarity s the overlap of x and y is
    at least s / (1 + s) * (|x| + |y|).
    """
    own = sets.select("node", F.col("members").alias("own"))
    middle = sets.select(F.col("node").alias("centre"), F.col("members").alias("middle"))
    rows = reliable(
        mixed.join(own, "node")
        .join(middle, "centre")
        .select("centre", "node", "root", "centre_root", "own", "middle")
        .mapInArrow(
            _differences,
            "centre bigint, node bigint, root bigint, centre_root bigint, n bigint, n_centre bigint, "
            "shared bigint, tokens array<bigint>",
        )
    )

    def overlap(n, m):
        return F.ceil(F.lit(threshold) * (n + m) / (100 + threshold) - 1e-9)

    def side(frame: DataFrame, name: str, *more) -> DataFrame:
        columns = ("node", "root", "n", "shared")
        renamed = [F.col(c).alias(name if c == "node" else f"{c}_{name}") for c in columns]
        return frame.select("centre", *renamed, F.size("tokens").alias(f"size_{name}"), *more)

    # What two sets share inside the centre is no more than either shares with it;
    # so many of their differences from it must agree to reach the threshold.
    need = overlap(F.col("n_a"), F.col("n_b")) - F.least("shared_a", "shared_b")
    apart = (F.col("root_a") != F.col("root_b")) & (
        100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    )
    left = rows.filter("root <> centre_root")
    y = side(left, "a", F.posexplode("tokens").alias("place_a", "token"))
    x = side(rows, "b", F.posexplode("tokens").alias("place_b", "token"))
    # Differences are in hash order: the first that agree lie this far from the end of both.
    by_token = y.join(x, ["centre", "token"]).filter(
        apart
        & (need > 0)
        & (F.col("place_a") + need <= F.col("size_a"))
        & (F.col("place_b") + need <= F.col("size_b"))
    )
    some = side(left.filter(100 * F.col("shared") >= threshold * F.col("n")), "a")
    small = side(rows.filter("n < n_centre"), "b")
    by_size = some.join(small, "centre").filter(apart & (need <= 0))
    return by_token.select("a", "b").unionAll(by_size.select("a", "b"))


def near_duplicates(
    docs: DataFrame, k: int = 2, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing:
    each is its own component. Rows with a null id take no part in links; their
    component is null and they are kept. Rows that repeat an id have the
    smallest component id among their texts' components reported per row.
    An empty table gives no rows. Other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = reliable(
        picked.mapInArrow(_sketch(k), "doc_id bigint, n bigint, print binary, sketch binary")
    )
    usable = rows.filter("doc_id is not null and print is not null")
    classes = reliable(
        usable.groupBy("print").agg(
            F.min("doc_id").alias("node"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
        )
    )
    banded = classes.select("node", "sketch").mapInArrow(_bands, "key bigint, node bigint")
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    buckets = reliable(banded.join(shared, "key"))
    wanted = buckets.select("node").distinct()
    # One text per class is enough: that of the smallest id, and of equal ids that of the class.
    texts = picked.join(wanted, F.col("doc_id") == F.col("node")).select("node", "text")
    sets = reliable(texts.mapInArrow(_sets(k), "node bigint, members binary"))

    # The most central member of a bucket is the one that meets most others in all its buckets.
    sized = buckets.join(buckets.groupBy("key").agg(F.count("*").alias("size")), "key")
    weight = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    rank = F.struct("weight", -F.col("node"))
    weighed = buckets.join(weight, "node")
    centres = weighed.groupBy("key").agg(F.max_by("node", rank).alias("centre"))
    centred = reliable(weighed.join(centres, "key").select("key", "node", "centre", "weight"))
    pairs = centred.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    tested = reliable(_ordered(pairs))
    links = _linked(tested, classes, sets, threshold)
    heavy = reliable(weight)
    for turn in range(STAR_ROUNDS + 1):
        mixed = reliable(_mixed(centred.select("key", "node", "centre"), _labels(links, heavy)))
        if not mixed.head(1):
            break
        if turn < STAR_ROUNDS:
            rest = mixed.filter("root <> centre_root").join(heavy, "node")
            next_ = rest.groupBy("centre").agg(
                F.max_by(F.struct("node", "root"), F.struct("weight", -F.col("node"))).alias("next")
            )
            found = rest.join(next_, "centre").filter("root <> next.root").select(
                F.col("node").alias("a"), F.col("next.node").alias("b")
            )
        else:
            found = _by_differences(mixed, sets, threshold)
        fresh = reliable(_ordered(found).join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionAll(fresh)
        links = links.unionAll(_linked(fresh, classes, sets, threshold))
    roots = reliable(components(links))

    named = (
        classes.join(roots, "node", "left")
        .select(
            F.col("print").alias("key"),
            F.coalesce("root", "node").alias("value"),
            F.col("copies").alias("occurrences"),
        )
    )
    found = lookup_join(rows.select("doc_id", "n", "print"), "print", reliable(named), "root")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

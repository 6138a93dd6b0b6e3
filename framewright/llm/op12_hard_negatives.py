"""Hard negatives by a multiway hyperplane tree (GNAT) over all vectors.

Inner products become distances: with a component that lifts every vector to
the largest norm, and 0 for queries, the squared distance is a constant of the
query less twice the product. So "a score between half and 95 % of the
positive's" is an annulus around the query.

A node of the tree holds some split points; a vector belongs to its nearest
one. Each split point keeps the range of its distances to every sibling's
subtree. By the triangle inequality a subtree whose range misses the annulus
around the query is left out. Leaves are cut into blocks with ranges of their
own; what survives is scored exactly.

The split points are chosen on a bounded sample; all vectors are routed, and
the ranges cover all of them. Leaves hold any number of blocks, in order of the
distance to their split point, so that no task holds a leaf. Vectors equal in
label and components are one entry with its smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.session import reliable

POSITIVES = 5
NEGATIVES = 3
# Negatives score between these percentages of the positive's score.
LOW, HIGH = 50, 95
# Split points of a node, sample entries that are no longer split, and the
# sample: entries and bytes.
FAN = 12
LEAF = 64
SAMPLE = 8_192
SAMPLE_BYTES = 16 << 20
# Entries of a block; bytes of query vectors searched at once.
BLOCK = 1_024
QUERY_BYTES = 8 << 20
# Queries whose products with a block are held at once.
_SOME = 64

_ROUTED = "dim int, leaf int, near double, label bigint, ids array<bigint>, vec array<bigint>"
_BLOCKS = (
    "dim int, leaf int, n int, ids binary, counts binary, labels binary, vecs binary, "
    "low array<double>, high array<double>"
)


def usable(
    df: DataFrame, factor: int, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """Distinct (id, label, vec): floor(factor * x) of each component, of rows that take part."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        doubles.alias("v"),
    ).na.drop()
    return (
        rows.filter((F.size("v") > 0) & ~odd)
        .select("id", "label", F.transform("v", lambda x: F.floor(x * factor).cast("bigint")).alias("vec"))
        .distinct()
    )


# --- the tree ---------------------------------------------------------------


@dataclass
class Node:
    """Split points ``first`` to ``first + len(children)``; a child below 0 is leaf ``-1 - child``."""

    first: int
    children: list[int]


@dataclass
class Tree:
    """Split points of one dimension, and what the ranges say of every leaf."""

    top2: float  # largest squared norm
    points: np.ndarray  # split points with their lifting component
    nodes: list[Node] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)  # of each leaf: (node, child)
    low: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    high: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def lift(self, vecs: np.ndarray) -> np.ndarray:
        plain = vecs.astype(np.float64)
        rest = np.sqrt(np.maximum(self.top2 - np.einsum("ij,ij->i", plain, plain), 0))
        return np.column_stack([plain, rest])

    def distances(self, lifted: np.ndarray, at: slice | np.ndarray) -> np.ndarray:
        """Of lifted vectors, which all have the largest norm, to split points."""
        return np.sqrt(np.maximum(2 * self.top2 - 2 * (lifted @ self.points[at].T), 0))

    def query_distances(self, queries: np.ndarray) -> np.ndarray:
        plain = queries.astype(np.float64)
        square = np.einsum("ij,ij->i", plain, plain)[:, None] + self.top2
        return np.sqrt(np.maximum(square - 2 * (plain @ self.points[:, :-1].T), 0))

    def route(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance to its split point) of every vector."""
        leaf, near = np.zeros(len(lifted), dtype=np.int32), np.zeros(len(lifted))
        todo = [(0, np.arange(len(lifted)))] if self.nodes else []
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            d = self.distances(lifted[rows], slice(node.first, node.first + len(node.children)))
            nearest = d.argmin(axis=1)
            for c, child in enumerate(node.children):
                mine = nearest == c
                if not mine.any():
                    continue
                if child >= 0:
                    todo.append((child, rows[mine]))
                else:
                    leaf[rows[mine]], near[rows[mine]] = -1 - child, d[mine, c]
        return leaf, near

    def path_points(self, leaf: int) -> np.ndarray:
        """Numbers of all split points along the path to a leaf."""
        spans = [np.arange(n.first, n.first + len(n.children)) for n in (self.nodes[i] for i, _ in self.paths[leaf])]
        return np.concatenate(spans) if spans else np.zeros(0, dtype=np.int64)

    def take_ranges(self, leaf: int, low: np.ndarray, high: np.ndarray) -> None:
        """Widen the ranges along a leaf's path: each split point to the subtree the path enters."""
        at = 0
        for step in self.paths[leaf]:
            n = len(self.nodes[step[0]].children)
            for held, some, widen in ((self.low, low, np.minimum), (self.high, high, np.maximum)):
                part = some[at : at + n]
                held[step] = widen(held[step], part) if step in held else part
            at += n


def fit(sample: np.ndarray, top2: float, fan: int = FAN, leaf: int = LEAF) -> Tree:
    """Split points of a tree over the sample, chosen far from each other among the first entries of a node."""
    tree = Tree(top2, np.zeros((0, sample.shape[1] + 1)))
    lifted = tree.lift(sample)
    chosen: list[np.ndarray] = []

    def grow(rows: np.ndarray, path: list[tuple[int, int]]) -> int:
        """Number of the node or leaf over these sample entries."""
        picked = _far_apart(lifted[rows[: 3 * fan]], fan) if len(rows) > leaf else []
        if len(picked) < 2:
            tree.paths.append(path)
            return -len(tree.paths)
        points = lifted[rows[picked]]
        number, node = len(tree.nodes), Node(sum(map(len, chosen)), [])
        tree.nodes.append(node)
        chosen.append(points)
        nearest = (lifted[rows] @ points.T).argmax(axis=1)
        for c in range(len(points)):
            node.children.append(grow(rows[nearest == c], [*path, (number, c)]))
        return number

    grow(np.arange(len(lifted)), [])
    if chosen:
        tree.points = np.concatenate(chosen)
    return tree


def _far_apart(candidates: np.ndarray, n: int) -> list[int]:
    """Places of up to n candidates, each the farthest from those before it."""
    picked = [0]
    least = ((candidates - candidates[0]) ** 2).sum(axis=1)
    while len(picked) < n and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, ((candidates - candidates[picked[-1]]) ** 2).sum(axis=1))
    return picked


# --- the index --------------------------------------------------------------


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of the vectors of each dimension."""
    lengths = column.value_lengths().to_numpy()
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)


def _route(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            for dim, rows, m in _matrices(batch.column(2)):
                leaf, near = trees[dim].route(trees[dim].lift(m))
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), dim, dtype=np.int32)),
                        pa.array(leaf),
                        pa.array(near),
                        *(some.column(i) for i in range(3)),
                    ],
                    names=["dim", "leaf", "near", "label", "ids", "vec"],
                )

    return run


def _pack(held):
    def block(tree: Tree, dim: int, leaf: int, rows: pa.RecordBatch, m: np.ndarray) -> pa.RecordBatch:
        d = tree.distances(tree.lift(m), tree.path_points(leaf))
        ids = rows.column(1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([dim], pa.int32()),
                pa.array([leaf], pa.int32()),
                pa.array([len(m)], pa.int32()),
                pa.array([ids.flatten().to_numpy().astype("<i8").tobytes()]),
                pa.array([ids.value_lengths().to_numpy().astype("<i4").tobytes()]),
                pa.array([rows.column(0).to_numpy().astype("<i8").tobytes()]),
                pa.array([m.astype("<i8").tobytes()]),
                pa.array([d.min(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([d.max(axis=0).tolist()], pa.list_(pa.float64())),
            ],
            names=["dim", "leaf", "n", "ids", "counts", "labels", "vecs", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            dims, leaves = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(leaves) != 0)) + 1
            for some in np.split(np.arange(len(dims)), cuts):
                for a in range(0, len(some), BLOCK):
                    at = int(some[a])
                    rows = batch.slice(at, len(some[a : a + BLOCK])).select(["label", "ids", "vec"])
                    dim = int(dims[at])
                    m = rows.column(2).flatten().to_numpy().reshape(-1, dim)
                    yield block(trees[dim], dim, int(leaves[at]), rows, m)

    return run


def build_index(entries: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF) -> tuple[DataFrame, dict[int, Tree]]:
    """(blocks, trees by dimension) over written entries (label, ids, vec).

    The driver holds one row per dimension, the sample, and for every leaf the
    ranges of the split points on its path; all bounded by the parameters.
    """
    spark = entries.sparkSession
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dims = {
        r["dim"]: r["top2"]
        for r in entries.groupBy(F.size("vec").alias("dim")).agg(F.max(norm).alias("top2")).collect()
    }
    room = SAMPLE_BYTES // (8 * max(dims, default=1))
    picked = entries.orderBy(F.xxhash64("vec"), "label").select("vec").limit(max(1, min(sample, room))).toArrow()
    by_dim = {dim: m for c in picked.column(0).chunks for dim, _, m in _matrices(c)} if picked.num_rows else {}
    trees = {
        dim: fit(by_dim.get(dim, np.zeros((0, dim), dtype=np.int64)), top2, fan, leaf) for dim, top2 in dims.items()
    }
    held = spark.sparkContext.broadcast(trees)
    routed = entries.select("label", "ids", "vec").mapInArrow(_route(held), _ROUTED)
    routed = reliable(routed)
    ordered = (
        routed.withColumn("tie", F.xxhash64("vec"))
        .repartitionByRange("dim", "leaf", "near", "tie")
        .sortWithinPartitions("dim", "leaf", "near", "tie")
    )
    blocks = reliable(ordered.select("dim", "leaf", "label", "ids", "vec").mapInArrow(_pack(held), _BLOCKS))
    ranges = (
        blocks.select("dim", "leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "r"))
        .groupBy("dim", "leaf", "at")
        .agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
        .groupBy("dim", "leaf")
        .agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("r"))
    )
    for r in ranges.collect():
        low, high = np.array([x["low"] for x in r["r"]]), np.array([x["high"] for x in r["r"]])
        trees[r["dim"]].take_ranges(r["leaf"], low, high)
    return blocks, trees


# --- the search -------------------------------------------------------------


@dataclass
class Asked:
    """Queries of one dimension: wanted score windows point at their vector."""

    names: np.ndarray  # of each window
    vector: np.ndarray  # place of each window's vector
    ids: np.ndarray
    labels: np.ndarray
    least: np.ndarray  # lowest and highest score that counts, per window
    most: np.ndarray
    vecs: np.ndarray


class Bounds:
    """Bounds of the scores of one dimension's queries, from ranges of distances."""

    def __init__(self, tree: Tree, asked: Asked):
        self.tree = tree
        plain = asked.vecs.astype(np.float64)
        self.square = np.einsum("ij,ij->i", plain, plain) + tree.top2
        self.slack = 1e-5 * self.square + 1
        self.d = tree.query_distances(asked.vecs)
        self.memo: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scores(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, rows=slice(None)):
        """(upper, lower) bound of the scores of vectors whose distances to the points lie in the ranges."""
        square, slack = self.square[rows], self.slack[rows]
        if not len(points):
            return np.full(len(square), np.inf), np.full(len(square), -np.inf)
        d = self.d[rows][:, points]
        least = np.maximum(np.maximum(d - high, low - d).max(axis=1), 0)
        most = (d + high).min(axis=1)
        return (square - least**2) / 2 + slack, (square - most**2) / 2 - slack

    def leaf(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for a leaf: every node on its path may rule it out, by the ranges of the subtree entered."""
        if leaf not in self.memo:
            upper, lower = np.full(len(self.square), np.inf), np.full(len(self.square), -np.inf)
            for step in self.tree.paths[leaf]:
                node = self.tree.nodes[step[0]]
                points = np.arange(node.first, node.first + len(node.children))
                u, w = self.scores(points, self.tree.low[step], self.tree.high[step])
                upper, lower = np.minimum(upper, u), np.maximum(lower, w)
            self.memo[leaf] = upper, lower
        return self.memo[leaf]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by float64 as long as every sum stays whole in it."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _search(held, same: bool, k: int):
    none = np.zeros(0, dtype=np.int64)

    def visit(asked: Asked, i: int, scores, wanted, entry_ids, starts, counts, best):
        """The window's best k after the block's wanted entries."""
        rows = np.flatnonzero(wanted)
        # One more than k, since one of the entries may hold nothing but the query's own id.
        if len(rows) > k + 1:
            least = np.partition(scores[rows], len(rows) - k - 1)[len(rows) - k - 1]
            rows = rows[scores[rows] >= least]
        n = counts[rows]
        flat = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
        names, found = entry_ids[flat], np.repeat(scores[rows], n)
        other = names != asked.ids[i]
        old_scores, old_names = best.get(i, (none, none))
        found, names = np.concatenate([old_scores, found[other]]), np.concatenate([old_names, names[other]])
        order = np.lexsort((names, -found))[:k]
        best[i] = found[order], names[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, queries = held.value
        bounds = {dim: Bounds(trees[dim], asked) for dim, asked in queries.items()}
        best: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {dim: {} for dim in queries}
        # Lowest score that can still enter a window's list.
        floors = {dim: asked.least.copy() for dim, asked in queries.items()}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in queries:
                    continue
                asked, floor = queries[dim], floors[dim]
                upper, lower = bounds[dim].leaf(row["leaf"])
                open_ = np.flatnonzero((upper[asked.vector] >= floor) & (lower[asked.vector] <= asked.most))
                if not len(open_):
                    continue
                points = trees[dim].path_points(row["leaf"])
                upper, lower = bounds[dim].scores(points, np.array(row["low"]), np.array(row["high"]))
                open_ = open_[(upper[asked.vector[open_]] >= floor[open_]) & (lower[asked.vector[open_]] <= asked.most[open_])]
                if not len(open_):
                    continue
                entry_ids = np.frombuffer(row["ids"], dtype="<i8")
                counts = np.frombuffer(row["counts"], dtype="<i4").astype(np.int64)
                starts = np.cumsum(counts) - counts
                labels = np.frombuffer(row["labels"], dtype="<i8")
                vecs = np.frombuffer(row["vecs"], dtype="<i8").reshape(-1, dim)
                for a in range(0, len(open_), _SOME):
                    some = open_[a : a + _SOME]
                    places, at = np.unique(asked.vector[some], return_inverse=True)
                    scores = _products(asked.vecs[places], vecs)[at]
                    alike = labels[None, :] == asked.labels[some][:, None]
                    wanted = (alike == same) & (scores >= floor[some][:, None]) & (scores <= asked.most[some][:, None])
                    for j in np.flatnonzero(wanted.any(axis=1)).tolist():
                        i = int(some[j])
                        visit(asked, i, scores[j], wanted[j], entry_ids, starts, counts, best[dim])
                        if len(best[dim][i][0]) == k:
                            floor[i] = max(floor[i], best[dim][i][0][-1])
        for dim, lists in best.items():
            if lists:
                names = queries[dim].names
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": np.concatenate([np.full(len(s), names[i]) for i, (s, _) in lists.items()]),
                        "score": np.concatenate([s for s, _ in lists.values()]),
                        "found_id": np.concatenate([n for _, n in lists.values()]),
                    }
                )

    return run


def _asked(rows: pa.Table, least: np.ndarray, most: np.ndarray) -> dict[int, Asked]:
    vectors = rows.column("vec").combine_chunks()
    names, ids, labels = (rows.column(c).to_numpy() for c in ("name", "id", "label"))
    out = {}
    for dim, at, m in _matrices(vectors):
        once, place = np.unique(m, axis=0, return_inverse=True)
        out[dim] = Asked(names[at], place.reshape(-1), ids[at], labels[at], least[at], most[at], once)
    return out


def _in_parts(blocks: DataFrame, trees, windows: DataFrame, same: bool, k: int, query_bytes: int) -> DataFrame:
    """(name, score, found_id, rank): the k best entries of every window.

    ``windows``: name (unique), id, label, vec, least, most; written. Parts of
    about ``query_bytes`` are broadcast one after the other, each until its own
    result is written.
    """
    spark = blocks.sparkSession
    total = windows.agg(F.coalesce(F.sum(F.size("vec") * 8 + 40), F.lit(0))).first()[0]
    parts = max(1, -(-total // query_bytes))
    first = W.partitionBy("name").orderBy(F.desc("score"), "found_id")
    out = None
    for p in range(parts):
        mine = windows.filter(F.pmod(F.xxhash64("vec"), F.lit(parts)) == p).toArrow()
        least, most = mine.column("least").to_numpy(), mine.column("most").to_numpy()
        held = spark.sparkContext.broadcast((trees, _asked(mine, least, most) if mine.num_rows else {}))
        found = blocks.mapInArrow(_search(held, same, k), "name bigint, score bigint, found_id bigint")
        ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        done = reliable(ranked)
        held.destroy()
        out = done if out is None else out.unionAll(done)
    return out


def hard_negatives(
    vectors: DataFrame,
    anchor_ids=lambda i: i % 50 == 0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    factor: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    query_bytes: int = QUERY_BYTES,
    sample: int = SAMPLE,
    fan: int = FAN,
    leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part. Rows equal in id, label and vector count
    once; an anchor finds no row of its own id; vectors are compared with those of
    their dimension. An anchor's positives are its best rows of the same label.
    For each, the best rows of other labels follow whose score is at least
    ``low`` and at most ``high`` percent of the positive's: none below a negative
    score, and only 0 below 0. Ties go to the smaller id. Fewer rows where there are
    fewer; an empty table gives none. Scores must fit 62 bits.
    """
    whole = usable(vectors, factor, id_col, label_col, vector_col)
    keep = max(positives, negatives) + 1
    once = W.partitionBy("vec", "label").orderBy("id")
    entries = (
        whole.withColumn("rank", F.row_number().over(once))
        .filter(F.col("rank") <= keep)
        .groupBy("vec", "label")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    blocks, trees = build_index(reliable(entries), sample, fan, leaf)
    edge = (1 << 62) - 1
    anchors = whole.filter(anchor_ids(F.col("id"))).withColumn("name", F.monotonically_increasing_id())
    anchors = anchors.select("name", "id", "label", "vec", F.lit(-edge).alias("least"), F.lit(edge).alias("most"))
    anchors = reliable(anchors)
    found = _in_parts(blocks, trees, anchors, True, positives, query_bytes)
    pairs = (
        found.select(F.col("name").alias("anchor"), "score", F.col("found_id").alias("positive_id"))
        .join(anchors.drop("least", "most"), F.col("anchor") == F.col("name"))
        .drop("name", "anchor")
    )
    # ceil(low * score / 100) to floor(high * score / 100), in whole numbers.
    scaled = F.col("score").cast("decimal(38,0)")
    windows = (
        pairs.filter("score >= 0")
        .withColumn("name", F.monotonically_increasing_id())
        .withColumn("least", F.ceil(scaled * low / 100).cast("bigint"))
        .withColumn("most", F.floor(scaled * high / 100).cast("bigint"))
    )
    windows = reliable(windows)
    mined = _in_parts(
        blocks, trees, windows.select("name", "id", "label", "vec", "least", "most"), False, negatives, query_bytes
    )
    named = windows.select(
        F.col("name").alias("window"), F.col("id").alias("anchor_id"), "positive_id", F.col("score").alias("positive_score")
    )
    return mined.join(named, F.col("name") == F.col("window")).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

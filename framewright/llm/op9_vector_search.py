"""Exact top-k inner products over a vector-approximation file.

Every component is quantised into one of 64 cells between the least and the
largest value of its dimension. The file holds blocks of cells next to the
exact vectors. For a query, the cells alone bound every inner product from
below and above. Candidates are then visited by falling upper bound, and their
exact vectors read, until no bound left reaches the k-th score found: the
result is exact.

Equal vectors are one candidate that carries its smallest ids, no more than can
appear in a result; so a vector that very many rows share costs as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.session import reliable

K = 5
CELLS = 64
# Vectors of one block of the file; bytes of query vectors broadcast at once.
BLOCK = 1_024
QUERY_BYTES = 8 << 20
_FEW = 128

_FILE = "dim int, n int, ids binary, counts binary, cells binary, exact binary"


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(id, vec): floor(factor * x) of each component, of rows that are usable."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return (
        df.select(F.col(id_col).cast("bigint").alias("id"), doubles.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
        .select("id", F.transform("v", lambda x: F.floor(x * factor).cast("bigint")).alias("vec"))
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, _, m in _matrices(batch.column(0)):
            low, high = seen.get(dim, (m[0], m[0]))
            seen[dim] = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
    rows = [(d, i, int(a), int(b)) for d, (lo, hi) in seen.items() for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (zip(*rows, strict=True))] if rows else [pa.array([], pa.int64())] * 4,
        names=["dim", "place", "low", "high"],
    )


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of the vectors of each dimension above 0."""
    lengths = column.value_lengths().to_numpy()
    for dim in np.unique(lengths).tolist():
        if dim == 0:
            continue
        rows = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy()
        yield dim, rows, flat.reshape(-1, dim)


def _pack(bounds: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for dim, rows, m in _matrices(batch.column(1)):
                low, step = bounds[dim]
                for a in range(0, len(rows), BLOCK):
                    part, some = m[a : a + BLOCK], [ids[r] for r in rows[a : a + BLOCK]]
                    cells = ((part - low) // step).astype(np.uint8)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([dim], pa.int32()),
                            "n": pa.array([len(some)], pa.int32()),
                            "ids": [np.array([x for s in some for x in s], dtype="<i8").tobytes()],
                            "counts": [np.array([len(s) for s in some], dtype="<i4").tobytes()],
                            "cells": [cells.tobytes()],
                            "exact": [part.astype("<i8").tobytes()],
                        },
                        schema=pa.schema(
                            [("dim", pa.int32()), ("n", pa.int32())]
                            + [(c, pa.binary()) for c in ("ids", "counts", "cells", "exact")]
                        ),
                    )

    return run


def build_file(vectors: DataFrame, keep_ids: int) -> tuple[DataFrame, dict]:
    """The file of all distinct vectors, each with its ``keep_ids`` smallest ids, and its cells.

    The rank filter becomes a limit per vector on every task before the
    shuffle, so a vector held by very many rows sends few of them.
    """
    once = W.partitionBy("vec").orderBy("id")
    few = (
        vectors.withColumn("rank", F.row_number().over(once))
        .filter(F.col("rank") <= keep_ids)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    few = reliable(few.select("ids", "vec"))
    found = (
        few.select("vec")
        .mapInArrow(_ranges, "dim bigint, place bigint, low bigint, high bigint")
        .groupBy("dim", "place")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .orderBy("dim", "place")
        .collect()
    )
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sorted({r["dim"] for r in found}):
        low = np.array([r["low"] for r in found if r["dim"] == dim])
        high = np.array([r["high"] for r in found if r["dim"] == dim])
        bounds[dim] = low, (high - low) // CELLS + 1
    return reliable(few.mapInArrow(_pack(bounds), _FILE)), bounds


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _visit(query, upper, near, exact, ids, starts, counts, scores, names, k):
    """Exact scores in falling order of the upper bound until the k-th is certain."""
    order = near[np.argsort(-upper[near], kind="stable")]
    for a in range(0, len(order), _FEW):
        some = order[a : a + _FEW]
        if len(scores) == k:
            some = some[upper[some] >= scores[-1]]
        if not len(some):
            break
        found = exact[some] @ query
        n = counts[some]
        flat = np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)
        scores, names = _best(
            np.concatenate([scores, np.repeat(found, n)]), np.concatenate([names, ids[flat]]), k
        )
    return scores, names


def _search(held, bounds, k: int):
    empty = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value  # {dim: (numbers, matrix)}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in queries:
                    continue
                low, step = bounds[dim]
                ids = np.frombuffer(row["ids"], dtype="<i8")
                counts = np.frombuffer(row["counts"], dtype="<i4").astype(np.int64)
                starts = np.cumsum(counts) - counts
                cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(-1, dim)
                exact = np.frombuffer(row["exact"], dtype="<i8").reshape(-1, dim)
                floor = (low + cells * step).astype(np.float64)
                numbers, matrix = queries[dim]
                for a in range(0, len(numbers), 256):
                    q = matrix[a : a + 256]
                    # Largest value of a cell minus its floor, where the query is positive.
                    slack = (np.maximum(q, 0) @ (step - 1)).astype(np.float64)
                    upper = q.astype(np.float64) @ floor.T + slack[:, None]
                    upper += np.abs(upper) * 1e-12 + 1
                    for i, number in enumerate(numbers[a : a + 256].tolist()):
                        scores, names = best.get(number, (empty, empty))
                        near = np.arange(len(counts))
                        if len(scores) == k:
                            near = np.flatnonzero(upper[i] >= scores[-1])
                        if len(near):
                            best[number] = _visit(
                                q[i], upper[i], near, exact, ids, starts, counts, scores, names, k
                            )
        for number, (scores, names) in best.items():
            yield pa.RecordBatch.from_pydict(
                {"number": np.full(len(scores), number, dtype=np.int64), "score": scores, "vec_id": names}
            )

    return run


def top_k(
    vectors: DataFrame,
    query_ids=lambda i: i % 50 == 0,
    k: int = K,
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query, exactly.

    Rows with a null id, a null vector, or a null or non-finite component take
    no part. Vectors are compared with those of their own dimension; empty ones
    with none. Rows that repeat id and vector count once, and a query never
    finds its own id. Scores must fit 64 bits. Ties go to the smaller id; fewer
    candidates than k give fewer rows; an empty table gives none. Distinct
    query vectors are broadcast in parts of ``query_bytes``, each part scanning
    the file once.
    """
    spark = vectors.sparkSession
    whole = whole_numbers(vectors, id_col, vector_col, factor)
    file, bounds = build_file(whole, k + 1)
    asked = reliable(
        whole.filter(query_ids(F.col("id"))).distinct().withColumn("place", F.xxhash64("vec"))
    )
    total = asked.agg(F.coalesce(F.sum(F.size("vec") * 8 + 8), F.lit(0))).first()[0]
    parts = max(1, -(-total // query_bytes))
    out = None
    for p in range(parts):
        mine = asked.filter(F.pmod("place", F.lit(parts)) == p)
        texts = [r[0] for r in mine.select("vec").distinct().collect() if len(r[0])]
        texts.sort()
        queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(t) for t in texts}:
            numbers = np.array([i for i, t in enumerate(texts) if len(t) == dim])
            queries[dim] = numbers, np.array([texts[i] for i in numbers.tolist()], dtype=np.int64)
        held = spark.sparkContext.broadcast(queries)
        # One more than k, since one of the found may be the query itself.
        found = file.mapInArrow(_search(held, bounds, k + 1), "number bigint, score bigint, vec_id bigint")
        first = W.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        lists = (
            found.withColumn("rank", F.row_number().over(first))
            .filter(F.col("rank") <= k + 1)
            .groupBy("number")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
        )
        named = spark.createDataFrame(list(enumerate(texts)), "number bigint, key array<bigint>")
        lists = lists.join(F.broadcast(named), "number").drop("number")
        # At most as many rows as the broadcast queries, k + 1 results each.
        rows = mine.join(F.broadcast(lists), F.col("vec") == F.col("key")).select(
            F.col("id").alias("query_id"),
            F.slice(
                F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k
            ).alias("found"),
        )
        rows = rows.select("query_id", F.posexplode("found").alias("at", "hit")).select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            F.col("hit.score").alias("score"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out

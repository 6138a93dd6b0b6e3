"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import reliable


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the smallest node reachable.

    ``links``: a, b. Each round hangs the larger neighbours of a node, then its
    smaller ones, on the smallest node near it, until every node hangs on a
    root; rounds grow with the logarithm of the number of nodes. Minima are
    combined on each task before the shuffle, and every round is written.
    """
    edges = reliable(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        near = near.select("n", F.least("n", "m").alias("m"))
        large = (
            both.join(near, F.col("a") == F.col("n"))
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        hung = large.join(low, F.col("a") == F.col("n"))
        edges = reliable(
            hung.filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        now = edges.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now

"""Mixing sources to target weights by a splitting tree of block quotas.

The words of a source lie in blocks: documents dealt by a hash of their id, so
that a source of any size has blocks of like size. A source takes each of its
blocks as often as its target holds the whole source, and of a permutation of
its blocks as many more as still fit; the block at the border is dealt into
smaller blocks, and so on, until the documents at the border are few; of these,
the choice that fills the quota best is taken. A document larger than what is
left of a quota is set aside; where something is left after the border, the
blocks behind it are gone through in the same way, until no document that was
passed over fits. Exact counts of taken blocks per source are then split among the output shards by a
binary tree: each node divides its blocks between its halves by a multivariate
hypergeometric draw. Shards take disjoint runs of the permuted blocks and are
shuffled locally.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.common import WORD, driver_table
from framewright.session import reliable

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2.0
# Blocks of a source on one level at most (more for very many words), and words below which documents are picked one by one.
FANOUT = 1_024
LAST_WORDS = 20_000
# Documents at a border that are picked one by one, whatever their words.
LAST_DOCS = 64
# Most words up to which the choice at a border is the best one; beyond, documents are taken as they fit.
BEST_WORDS = 1 << 22
# Least shards, and words of a shard or a block from which there are more of them.
SHARDS = 64
SHARD_WORDS = 4_000_000


def targets(
    sizes: list[tuple[str | None, int]],
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeat: float = REPEAT,
) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of each source, by code point, null last.

    Weights repeat along that order. Sources above ``repeat`` times their size
    stop there; what they leave is shared by weight among the others, until
    none is above. One row per source: this is the only thing held by the driver.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    target = [0.0] * len(ordered)
    open_ = list(range(len(ordered)))
    rest = share * sum(n for _, n in ordered)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if rest * weight[i] / total > repeat * ordered[i][1]]
        if not over:
            for i in open_:
                target[i] = rest * weight[i] / total
            break
        for i in over:
            target[i] = repeat * ordered[i][1]
            rest -= target[i]
        over_set = set(over)
        open_ = [i for i in open_ if i not in over_set]
    return [(s, n, t) for (s, n), t in zip(ordered, target, strict=True)]


def best_fit(words: list[int], left: int) -> list[bool]:
    """Which of the documents to take so that their words come nearest to ``left`` from below.

    Sums that can be reached are the bits of a number, one number per document;
    among equal sums earlier documents are preferred.
    """
    below = (1 << left + 1) - 1
    reach = [1]
    for n in words:
        reach.append(reach[-1] if n > left else (reach[-1] | reach[-1] << n) & below)
    goal, taken = reach[-1].bit_length() - 1, [False] * len(words)
    for i in range(len(words) - 1, -1, -1):
        if not reach[i] >> goal & 1:
            taken[i] = True
            goal -= words[i]
    return taken


def _pick(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the documents at the border of one source, in permuted order, those that fill it best."""
    left = float(rows["left"].iloc[0])
    ordered = rows.sort_values(["place", "doc_id", "size"], na_position="first")
    words = ordered["words"].tolist()
    if left <= BEST_WORDS:
        taken = best_fit(words, int(left))
    else:
        taken = []
        for n in words:
            taken.append(n <= left)
            left -= n if taken[-1] else 0
    return ordered.assign(extra=np.array(taken, dtype=int))[["source", "doc_id", "size", "words", "extra"]]


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    tests = [left[n].eqNullSafe(right[n]) for n in names]
    return tests[0] if len(tests) == 1 else tests[0] & _same(left, right, names[1:])


def _quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source in each shard: rows are sources, sums are exact."""
    if shards == 1:
        return counts[:, None]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(
        counts, int(counts.sum()) * left // shards, method="marginals"
    )
    return np.hstack(
        [_quotas(drawn, left, rng), _quotas(counts - drawn, shards - left, rng)]
    )


def plan_mix(
    docs: DataFrame,
    seed: int = 1,
    shards: int | None = None,
    fanout: int | None = None,
    last_words: int = LAST_WORDS,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeat: float = REPEAT,
) -> DataFrame:
    """One row per distinct (doc_id, source, size): how often it is taken, and by which shards.

    Columns: doc_id, source, size, rows (how many rows of ``docs`` these are; they
    share one fate), source_size, target, copies, shards (array, one per copy).
    A null or blank text has size 0 and is taken as its block is; null sources
    are a source; null ids are an id. An empty table gives no rows. Every draw
    is a hash of the seed or of a seeded generator, so reruns agree. ``docs``
    needs doc_id, text and source; other columns are ignored. Shards, and the
    blocks of a source, grow with the words (None: at least SHARDS and FANOUT, and
    one for every SHARD_WORDS), so that neither outgrows a task.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    keyed = reliable(
        keyed.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn("place", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
    )
    found = keyed.groupBy("source").agg(F.sum("words")).collect()
    aims = targets([(r[0], r[1]) for r in found], weights, share, repeat)
    if shards is None:
        shards = max(SHARDS, math.ceil(sum(t for *_, t in aims) / SHARD_WORDS))
    if fanout is None:
        fanout = max(FANOUT, math.ceil(max((n for _, n, _ in aims), default=0) / SHARD_WORDS))
    base = [(s, n, t, min(int(t // n), int(repeat)) if n else 0) for s, n, t in aims]
    aim = driver_table(
        spark,
        base,
        pa.schema(
            [("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int32())]
        ),
    )

    border = aim.select(
        "source", F.col("source_size").alias("words"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
    ).filter("left > 0 and words > 0")
    quota = border.select("source", "left")
    candidates, chosen, level = keyed.filter("words > 0"), [], 0
    while True:
        # One way along the blocks: down to the documents at the border, then on with what lies behind it.
        open_, passed, whole_quota, taken = candidates, [], quota, []
        while True:
            inside = open_.join(
                F.broadcast(quota.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))
            ).drop("s").filter(F.col("words") <= F.col("left"))
            sizes = reliable(inside.groupBy("source").agg(F.sum("words").alias("all")))
            blocks_of = F.least(F.lit(fanout), F.ceil(F.col("all") / last_words)).cast("bigint")
            inside = inside.join(
                F.broadcast(sizes.select(F.col("source").alias("s"), blocks_of.alias("blocks"))),
                F.col("source").eqNullSafe(F.col("s")),
            ).drop("s")
            inside = inside.withColumn(
                "block", F.pmod(F.xxhash64("place", F.lit(level), F.lit(seed)), F.col("blocks"))
            )
            blocks = inside.groupBy("source", "block", "left").agg(
                F.sum("words").alias("words"), F.count("*").alias("docs")
            )
            order = W.partitionBy("source").orderBy(
                F.xxhash64("block", F.lit(level), F.lit(seed + 1)), "block"
            )
            run = blocks.withColumn("end", F.sum("words").over(order))
            run = reliable(
                run.filter(F.col("end") - F.col("words") < F.col("left")).withColumn(
                    "full", F.col("end") <= F.col("left")
                )
            )
            taken.append(run.filter("full").select("source", "words"))
            on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
            met = run.select(
                F.col("source").alias("s"), F.col("block").alias("b"), "full",
                (F.col("left") - F.col("end") + F.col("words")).alias("left"),
            )
            joined = inside.drop("left").join(met, on)
            chosen.append(
                joined.filter("full").select(
                    "source", "doc_id", "size", F.lit(1).alias("extra"),
                    F.lit(level).alias("level"), F.col("block").alias("extra_block"),
                )
            )
            passed.append(
                inside.join(met.select("s", "b"), on, "left_anti").select(*keyed.columns)
            )
            open_ = reliable(joined.filter("not full").select(*keyed.columns, "left"))
            quota = run.filter("not full").select(
                "source", (F.col("left") - F.col("end") + F.col("words")).alias("left")
            )
            level += 1
            many = run.filter("not full").filter(
                (F.col("words") > last_words) & (F.col("docs") > LAST_DOCS)
            )
            if not many.head(1):
                break
            open_ = open_.drop("left")
        picked = reliable(
            open_.groupBy("source").applyInPandas(
                _pick, "source string, doc_id bigint, size bigint, words bigint, extra int"
            )
        )
        chosen.append(
            picked.filter("extra > 0").select(
                "source", "doc_id", "size", "extra", F.lit(level).alias("level"),
                F.lit(0).cast("bigint").alias("extra_block"),
            )
        )
        used = picked.filter("extra > 0").select("source", "words")
        for more in taken:
            used = used.unionAll(more)
        used = used.groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("used"))
        quota = reliable(
            whole_quota.join(F.broadcast(used), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")
            )
        )
        behind = passed[0]
        for more in passed[1:]:
            behind = behind.unionAll(more)
        candidates = reliable(
            behind.join(
                F.broadcast(quota.withColumnRenamed("source", "s")),
                F.col("source").eqNullSafe(F.col("s")) & (F.col("words") <= F.col("left")),
            ).select(*keyed.columns)
        )
        level += 1
        if not candidates.head(1):
            break
    extra = chosen[0]
    for more in chosen[1:]:
        extra = extra.unionAll(more)
    extra = extra.toDF("s", "d", "n", "extra", "level", "extra_block")
    first = keyed.join(
        F.broadcast(aim.withColumnRenamed("source", "s0")), F.col("source").eqNullSafe(F.col("s0"))
    ).drop("s0")
    plan = first.join(
        extra,
        F.col("doc_id").eqNullSafe(F.col("d"))
        & F.col("source").eqNullSafe(F.col("s"))
        & (F.col("size") == F.col("n")),
        "left",
    ).withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    main_block = F.pmod(
        F.xxhash64("place", F.lit(0), F.lit(seed)),
        F.greatest(
            F.lit(1), F.least(F.lit(fanout), F.ceil(F.col("source_size") / last_words))
        ).cast("bigint"),
    )
    plan = plan.withColumn(
        "units",
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.lit(int(repeat))),
                lambda i: F.when(
                    i < F.col("whole"),
                    F.struct((-1 - i).cast("int").alias("level"), main_block.alias("block")),
                ),
            ),
            F.array(
                F.when(
                    F.col("extra") > 0,
                    F.struct(
                        F.col("level").cast("int").alias("level"), F.col("extra_block").alias("block")
                    ),
                )
            ),
        ),
    ).withColumn("units", F.filter("units", lambda u: u.isNotNull()))
    plan = reliable(plan)
    return _deal(plan, seed, shards)


def _deal(plan: DataFrame, seed: int, shards: int) -> DataFrame:
    """Give each taken block a shard by the splitting tree, and each row its blocks' shards."""
    spark = plan.sparkSession
    units = (
        plan.select("source", F.explode("units").alias("unit"))
        .distinct()
        .select("source", "unit.level", "unit.block")
    )
    order = W.partitionBy("source").orderBy(
        F.xxhash64("level", "block", F.lit(seed + 2)), "level", "block"
    )
    units = reliable(units.withColumn("rank", F.row_number().over(order) - 1))
    counts = sorted(
        units.groupBy("source").count().collect(), key=lambda r: (r[0] is None, r[0] or "")
    )
    if not counts:
        return plan.select(
            "doc_id", "source", "size", "rows", "source_size", "target", "copies",
            F.array().cast("array<int>").alias("shards"),
        )
    rng = np.random.default_rng(seed)
    quotas = _quotas(np.array([r[1] for r in counts], dtype=np.int64), shards, rng)
    ends = driver_table(
        spark,
        [(r[0], q) for r, q in zip(counts, np.cumsum(quotas, axis=1).tolist(), strict=True)],
        pa.schema([("s", pa.string()), ("ends", pa.list_(pa.int64()))]),
    )
    placed = (
        units.join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
        .select(F.col("source").alias("s"), "level", "block", "shard")
    )
    long = plan.select(
        "doc_id", "source", "size", "rows", "source_size", "target", "copies",
        F.explode_outer("units").alias("unit"),
    )
    long = long.join(
        placed,
        F.col("source").eqNullSafe(F.col("s"))
        & (F.col("unit.level") == F.col("level"))
        & (F.col("unit.block") == F.col("block")),
        "left",
    )
    return long.groupBy(
        "doc_id", "source", "size", "rows", "source_size", "target", "copies"
    ).agg(F.array_sort(F.collect_list("shard")).alias("shards"))


def mix(docs: DataFrame, seed: int = 1, **settings) -> DataFrame:
    """The documents of the mix: all columns, a row per taken copy.

    Rows come by shard, shuffled inside each shard by a seeded hash. Columns
    ``mix_shard`` and ``mix_place`` are added. See ``plan_mix`` for odd cases.
    """
    plan = plan_mix(docs, seed, **settings).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "shards"
    )
    names = docs.columns
    own = docs.withColumn(
        "_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    )
    taken = own.join(
        plan.filter(F.size("shards") > 0),
        F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d"))
        & F.col("source").cast("string").eqNullSafe(F.col("_s"))
        & (F.col("_size") == F.col("_n")),
    )
    dealt = taken.select(*names, F.posexplode("shards").alias("_copy", "mix_shard")).withColumn(
        "mix_place", F.xxhash64("doc_id", "_copy", F.lit(seed + 3))
    )
    return (
        dealt.repartition("mix_shard")
        .sortWithinPartitions("mix_shard", "mix_place")
        .select(*names, "mix_shard", "mix_place")
    )

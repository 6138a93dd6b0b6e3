"""Left join to a table of unique keys that stays balanced under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import col

# A key held by more than this share of the rows is heavy: 1 / HEAVY_PARTS.
HEAVY_PARTS = 1_000
# Longer keys are broadcast as a digest; with HEAVY_PARTS this bounds the bytes.
HEAVY_KEY_BYTES = 64
SPREAD = 4_096


def _spread_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPREAD).cast("bigint"))


def _bounded(key: Column) -> Column:
    """The key's bytes, or the SHA-256 of a long key."""
    data = key.cast("binary")
    return F.when(F.octet_length(data) <= HEAVY_KEY_BYTES, data).otherwise(F.unhex(F.sha2(data, 256)))


def lookup_join(df: DataFrame, key: str, lookup: DataFrame, name: str) -> DataFrame:
    """``df`` with the lookup's value of ``key`` as column ``name``.

    ``lookup`` is ``(key, value, occurrences)`` with unique keys and, in
    ``occurrences``, how many rows of ``df`` hold the key. Heavy keys (at most
    HEAVY_PARTS of them, because their rows add up to no more than all rows)
    are broadcast; the others are shuffled. Rows that need no shuffled match
    carry a null key, and a second key made from their row number spreads them
    over all tasks; for the others the second key follows from the first.
    """
    total = lookup.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n")).scalar()
    is_heavy = F.col("occurrences") * HEAVY_PARTS > total
    heavy = lookup.filter(is_heavy).select(
        _bounded(F.col("key")).alias("_heavy_key"), F.col("value").alias("_heavy_value")
    )
    light = lookup.filter(~is_heavy).select(
        F.col("key").alias("_light_key"),
        _spread_of(F.col("key")).alias("_light_spread"),
        F.col("value").alias("_light_value"),
    )
    probed = df.join(F.broadcast(heavy), _bounded(col(key)) == F.col("_heavy_key"), "left")
    open_key = F.when(F.col("_heavy_key").isNull(), col(key))
    probed = probed.withColumn("_open_key", open_key).withColumn(
        "_spread",
        F.when(F.col("_open_key").isNotNull(), _spread_of(F.col("_open_key"))).otherwise(
            F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
        ),
    )
    joined = probed.join(
        light,
        (F.col("_open_key") == F.col("_light_key")) & (F.col("_spread") == F.col("_light_spread")),
        "left",
    )
    return joined.select(
        *[col(n) for n in df.columns],
        F.coalesce("_heavy_value", "_light_value").alias(name),
    )

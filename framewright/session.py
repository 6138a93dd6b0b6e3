"""Session settings and the shared places jobs may write to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def build_session(master: str | None = None, app_name: str = "framewright", **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings stay as submitted."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Recording the Python line of every expression slows planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_bytes(spark: SparkSession) -> int:
    """The most bytes of a file that one task reads, where files are split."""
    named = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named)


def shared_root(spark: SparkSession) -> str:
    """The folder for written stages, reachable from driver and executors.

    ``spark.checkpoint.dir`` where it is set, else a folder below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; the open scope, if any, owns it."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows at a path, none where nothing was written yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside, for what is run there."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, every shared path that was asked for inside.

    Results that still read those stages have to be written before.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            remove_path(spark, path)


def reliable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write the frame to the shared folder and go on from there.

    Cuts the lineage, so nothing before it runs again, and a lost executor
    only rereads. Parquet keeps later reads to the columns they need. With
    ``keep`` the stage outlives the innermost open scope.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    if keep and _scopes:
        _scopes[-1].remove(path)
        if len(_scopes) > 1:
            _scopes[-2].append(path)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)

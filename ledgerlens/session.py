"""Session defaults and lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK_DIRS: dict[str, str] = {}
_OWNED: ContextVar[list[DataFrame] | None] = ContextVar("owned", default=None)


def build_session(app_name: str = "ledgerlens", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture costs milliseconds per Column operator while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    On one machine a private temporary folder stands in where the setting is absent. On a cluster that
    would leave every executor with files of its own, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK_DIRS:
        _FALLBACK_DIRS[app] = tempfile.mkdtemp(prefix="ledgerlens-")
    return _FALLBACK_DIRS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once as ZSTD Parquet in the shared folder and read it back.

    The written table survives executor loss, cuts lineage, and gives the
    planner a real size, so later joins are chosen from facts. The number of rows is
    observed while writing and kept for row_count().
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    with _short_methods(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_path = path
    written._written_rows = seen.get["rows"]
    if _OWNED.get() is not None:
        _OWNED.get().append(written)
    return written


@contextmanager
def _short_methods(spark: SparkSession) -> Iterator[None]:
    """Stages whose generated method is too long for the JVM to compile (8000 bytes of bytecode) run by operators meanwhile: interpreted, one method for
    all rules or forms of a row takes up to twice the time. Results don't depend on it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(8000, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hold(df: DataFrame) -> DataFrame:
    """Keep a frame's partitions on the executors' disks until release() or the end of scratch(); lost ones are worked out again."""
    df.persist(StorageLevel.DISK_ONLY)
    if _OWNED.get() is not None:
        _OWNED.get().append(df)
    return df


def release(df: DataFrame) -> None:
    """Let go of what hold() keeps."""
    if df.storageLevel.useDisk:
        df.unpersist()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Owns the tables that materialize() writes and hold() keeps inside and lets go of them at the end, but for those that are passed to what it yields.

    Use it where the result is written inside, so that no plan refers to the other tables any more.
    """
    owned: list[DataFrame] = []
    token = _OWNED.set(owned)
    kept: set[str | None] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_written_path", None))
        return df

    try:
        yield keep
    finally:
        _OWNED.reset(token)
        outer = _OWNED.get()
        for df in owned:
            if getattr(df, "_written_path", None) not in kept or df.storageLevel.useDisk:
                discard(df)
                release(df)
            elif outer is not None:
                outer.append(df)


def row_count(df: DataFrame) -> int | None:
    """Rows of a frame made by materialize(), None for any other frame."""
    return getattr(df, "_written_rows", None)


def is_written(df: DataFrame) -> bool:
    """Whether this very frame is a table made by materialize()."""
    return getattr(df, "_written_path", None) is not None


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no plan refers to any more."""
    path = getattr(df, "_written_path", None)
    if path is not None:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

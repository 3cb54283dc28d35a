"""Session defaults and durable staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "freightlens", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; `conf` overrides win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: `spark.checkpoint.dir` when the cluster names one.

    Only a local master may fall back to a private temporary folder; elsewhere executors
    would not see it, so the job stops instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _own_folder()


@cache
def _own_folder() -> str:
    """One private folder per process, for a local master without a configured one."""
    return tempfile.mkdtemp(prefix="freightlens-")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def staging(spark: SparkSession):
    """Folders made inside are deleted at the end; for work whose results are values, not frames that read them."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = os.path.join(checkpoint_root(spark), "freightlens", f"{label}-{uuid.uuid4().hex}")
    for made in _scopes.get():
        made.append(path)
    return path


def local_path(spark: SparkSession, path: str) -> str | None:
    """A path of the shared folder as open() takes it; None if that is in a store that only Spark reaches."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(folder).toUri().getPath() if files.getUri().getScheme() == "file" else None


#: Values at their full width, in row groups of 32 MB: the bytes of a split then tell how many rows a task gets.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}


def stage(df: DataFrame, label: str = "stage", plain: bool = False) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    Used where several jobs read the same derived rows. Unlike a cache it survives the loss of
    executors, cuts lineage, and keeps column pruning and filter pushdown for its readers. Readers that
    hold a whole partition as objects need it `plain`: encoded values would put millions of rows into one.
    """
    path = new_folder(df.sparkSession, label)
    df.write.options(**PLAIN if plain else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

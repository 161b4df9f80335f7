"""What all parts of the engine share: size-checked broadcasts, and tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[list[str]] = []  # folders made within scratch() blocks


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="statuta-")
        shared_dir.local = base
    return base.rstrip("/")


def internal(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder below the shared one."""
    path = f"{shared_dir(spark)}/statuta/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so a lost executor costs a reread."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stashes(spark: SparkSession) -> None:
    """Delete all that this application has stashed; DataFrames that read from it are of no more use."""
    drop_path(spark, f"{shared_dir(spark)}/statuta/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed within the block is deleted at its end. For work whose result has been written elsewhere by then."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made[:] = [x for x in _made if x is not made]
        for path in made:
            drop_path(spark, path)


def small(rows: DataFrame, limit: int = 50_000) -> DataFrame:
    """rows, to be broadcast if a count finds at most `limit` of them; else Spark joins them by a shuffle."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out if they lie in fewer partitions than there are cores: before work on each row that is dear. A large table stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)

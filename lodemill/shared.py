"""Tables in the folder that driver and executors share: cut lineage, and dropping them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a single-JVM session (local, local[...]), as in tests, gets a folder of its own where the setting is
    missing; on a cluster a missing setting is an error, as a local folder would be lost with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodemill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, dropped at the end of scratch()."""
    path = f"{shared_dir(spark)}/lodemill/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


#: Spark's setting (4.1) that drops an execution's shuffle files at its end; without it they stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and an executor's loss costs one read.

    release: the shuffle files of the write go with its end; for large ones, that else lie on disk beside those of the next step."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks a core that spread() deals rows to.
SPREAD = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt evenly (or by keys) to all cores, for work that costs much by the row: a table of few row groups is read by as few tasks, whatever
    the cluster. Dealt by keys there are as many tasks as shuffles are set to have, if those are more, and none are put together."""
    n = SPREAD * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if keys else df.repartition(n)


def kept(df: DataFrame, name: str) -> DataFrame:
    """written(), for the result of a scratch() block: it outlasts the block and goes with the one around it, if any."""
    inner = _scratch.pop() if _scratch else None
    try:
        return written(df, name)
    finally:
        if inner is not None:
            _scratch.append(inner)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table by Hadoop's file system, whatever store it is in."""
    store, target = _at(spark, path)
    store.delete(target, True)


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    store, target = _at(spark, path)
    return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end. Results that are read after it must have been stored elsewhere: what is
    returned by an operator is lazy and reads its tables when it runs."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop(spark, path)

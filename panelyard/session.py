"""Session helpers: reliable checkpoints and the degree of parallelism."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="panelyard-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


_LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here are deleted once it has run, not when the driver's memory is next cleaned.

    Batches for Python workers hold 8 MB: rows that are blocks of records would
    else fill buffers outside the heap.
    """
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written below the shared folder and read again.

    Unlike a checkpoint it also forgets what the planner inferred about the
    columns, which grows from round to round in a loop. Shuffles on the way are deleted.
    """
    path = scratch_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """How many ways a large sort or group may be split."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer parts than cores, dealt out evenly; any other scan is left alone.

    Few large row groups would otherwise keep costly text work in few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` is proven to hold at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows

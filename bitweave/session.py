"""Session helpers shared by every operator: table access, shared scratch space, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in at least as many partitions as there are cores, for work that costs far
    more than reading. A table of enough splits stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle whose work is out of proportion to its bytes: the session's number
    of shuffle partitions, at least one per core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset (local tests) a
    temporary folder is made and set as the context's checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bitweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder (eager)."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the table is compressed, columnar and has known size statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Size in bytes that the optimizer estimates for ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with none of ``columns`` (letter case is ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

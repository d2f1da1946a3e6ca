"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bits of a row's place in its file.
_IN_FILE = 40


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that has none gets a temporary one."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; an executor's loss does not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df kept as Parquet in the shared folder and read from there."""
    kept = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(kept)
    return df.sparkSession.read.schema(df.schema).parquet(kept)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which with a large heap may be long after many small
    steps have filled the disks; spark.cleaner.periodicGC.interval asks for the same every half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, the same in every reading, and its column's name.

    docs is a table of Parquet files as it is read (its columns may be chosen or replaced and its rows filtered), whose rows are numbered by
    their file, in the order of paths, and their place in it, so nothing is written. Other tables are kept as Parquet in the shared
    folder first, as their rows have no lasting place. What was joined or exploded is to be written before.
    """
    key = unused(docs, "row_key")
    path, at = unused(docs, "row_file"), unused(docs, "row_at")
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of the table's own")
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
        placed.schema  # noqa: B018  resolved here, so that tables without places are told apart
    except AnalysisException:
        rows = docs.withColumn(key, F.monotonically_increasing_id())
        kept = f"{shared_dir(docs.sparkSession)}/keyed-{uuid.uuid4().hex}"
        rows.write.parquet(kept)
        return docs.sparkSession.read.schema(rows.schema).parquet(kept), key
    # one row for each file
    files = checkpointed(placed.select(path).distinct()).select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias(key))
    numbered = placed.join(F.broadcast(files), path)
    return numbered.select(*docs.columns, (F.shiftleft(key, _IN_FILE) + F.col(at)).alias(key)), key

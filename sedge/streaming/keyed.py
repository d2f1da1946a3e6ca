"""Totals of a stream by key in keyed state: rows that were seen before count once, and a batch writes the keys that it changed."""

from __future__ import annotations

import uuid
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sedge.streaming.shared import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_totals(stream: DataFrame, key: str, id_col: str, kind_col: str, groups: dict[str, tuple[str, ...]], base: str | None = None) -> DataFrame:
    """key, rows and a number for each of groups, batch: what each key has after all that the stream has now.

    Keys and ids are told apart as text. A row whose id its key has seen, in this run or one before it from the same ``base``, counts for nothing; null ids are one id, null keys one
    key. The state holds keys with their ids as single entries on disk, so a key may have any number; both steps of state are Spark's own. A batch writes the keys it changed under its own number, so one that is done again
    replaces itself; batch is the last one that changed the key. Without rows the result is empty.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/keyed-stream-{uuid.uuid4().hex}"
    schema = StructType([StructField("key", StringType()), *(StructField(n, LongType()) for n in ("rows", *groups))])
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        # as text with a sign before it, so that the key of no key is one too
        text = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
        thin = stream.select(text.alias("key"), F.col(id_col).cast("string").alias("id"), F.col(kind_col).alias("kind"))
        numbers = [F.count_if(F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).alias(n) for n, kinds in groups.items()]
        changed = thin.dropDuplicates(["key", "id"]).groupBy("key").agg(F.count("*").alias("rows"), *numbers)
        query = (
            changed.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        kept = spark.read.schema(whole).parquet(f"{base}/changes")
    except AnalysisException:  # no batch at all
        kept = spark.createDataFrame([], whole)
    last = Window.partitionBy("key").orderBy(F.desc("batch"))
    rows = kept.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    back = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(stream.schema[key].dataType)
    return rows.select(back.alias(key), "rows", *groups, "batch")

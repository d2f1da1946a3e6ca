"""Running totals of a file stream, kept by key in Spark's state store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame

from sedge.streaming.shared import shared_dir


def totals(stream: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """by and aggs over all that a stream has now; one row a key.

    Each micro-batch writes the keys' whole totals under its own number, so a batch that is done again
    replaces itself. The stream ends when all rows that were there have been taken; one without rows gives an empty table.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/totals/{number}")
        last.append(number)

    totalled = stream.groupBy(*by).agg(*aggs)
    query = totalled.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:  # no batch at all
        return spark.createDataFrame([], totalled.schema)
    return spark.read.schema(totalled.schema).parquet(f"{base}/totals/{last[-1]}")

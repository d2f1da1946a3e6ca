"""Where the modules of this folder enter their queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Rows of a part of a table that is dealt by a key.
PART_ROWS = 500_000


def dealt(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """df in parts by a key, as many as its rows (counted, or as given) ask for, so that a task's sorts and groups do not grow with the table; what follows by this key moves nothing."""
    parts = -(-(df.count() if rows is None else rows) // PART_ROWS)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

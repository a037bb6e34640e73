"""Session views, replaced tables and the audience log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_view(df: DataFrame, name: str) -> DataFrame:
    """Publish ``df`` under a name for SQL text in this session."""
    df.createOrReplaceTempView(name)
    return df


def replace_table(df: DataFrame, table: str, path: str | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """Create or replace a stored table from ``df``.

    ``bucket_by=(512, "account_id")`` stores the table in key buckets. Tables bucketed alike
    join on the key without a shuffle, which pays for the monthly, daily and offer tables
    that nearly every analysis joins on the account. Each task writes its own file per
    bucket; moving rows to one task per bucket first would gather a hot key in one task.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
    writer.saveAsTable(table)


def append_audience(df: DataFrame, adjudicated_at: dt.datetime, table: str | None = None, path: str | None = None) -> None:
    """Put one adjudication run into the audience log, stamped with its time.

    The log is partitioned by day and run. Files are staged and take the place of the run's partition when
    all are there, so a run that is repeated replaces itself, also by fewer rows or none. Later
    readers that want decisions after some date prune to those partitions.
    """
    if (table is None) == (path is None):
        raise ValueError("give a table name or a path")
    parts = {"adjudicated_date": f"{adjudicated_at:%Y-%m-%d}", "adjudicated_run": f"{adjudicated_at:%Y%m%d%H%M%S}"}
    stamped = df.withColumn("adjudicated_at", F.lit(adjudicated_at))
    placed = stamped.withColumns({name: F.lit(value) for name, value in parts.items()})
    if table:
        placed.limit(0).write.mode("ignore").format("parquet").partitionBy(*parts).saveAsTable(table)
        one = ", ".join(f"{name} = '{value}'" for name, value in parts.items())
        df.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({one}) BY NAME SELECT * FROM {{run}}", run=stamped)
        return
    if stamped.limit(1).count():
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format("parquet").partitionBy(*parts).save(path)
    else:  # a dynamic overwrite without rows would leave the partition as it was
        stamped.write.mode("overwrite").format("parquet").save("/".join([path, *(f"{name}={value}" for name, value in parts.items())]))


def to_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON record, for chart layers; meant for aggregates."""
    return df.select(F.to_json(F.struct("*")).alias("record"))

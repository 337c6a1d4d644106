"""Incremental ingest as a file stream: each batch is synced by key into a table, with retention.

The table is cut into buckets by key.  A batch reads and writes only the buckets that its
keys fall to, under its own number; a manifest says which number each bucket has now.  A batch
that is run again finds the manifest of the one before and writes the same.  Buckets that the
batch before has replaced are deleted, as nothing can ask for them any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import kept_path

BUCKETS = 64


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, so a hot key is combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def _manifest(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    """The number under which each bucket stands after a batch."""
    if number < 0:
        return {}
    return {r["bucket"]: r["number"] for r in spark.read.parquet(f"{table}/manifest/v={number}").collect()}  # a row for each bucket


def _buckets(table: str, numbers: dict[int, int]) -> list[str]:
    return [f"{table}/rows/v={n}/bucket={b}" for b, n in sorted(numbers.items())]


def read_table(spark: SparkSession, table: str, number: int, schema: StructType, keep: str | None = None) -> DataFrame:
    """The rows after a batch; ``keep`` is retention for buckets that no later batch has touched."""
    paths = _buckets(table, _manifest(spark, table, number))
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.filter(keep) if keep else rows


def upsert_batch(table: str, key: str, order: list[str], keep: str, buckets: int = BUCKETS):
    """For foreachBatch: the batch's rows put into the buckets of their keys, newest per key, after retention (SQL ``keep``)."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.filter(keep)
        before, now = _manifest(spark, table, number - 2), _manifest(spark, table, number - 1)
        touched = [r[0] for r in rows.select(place.alias("b")).distinct().collect()]  # as many as buckets at most
        old = _buckets(table, {b: now[b] for b in touched if b in now})
        if old:
            rows = rows.unionByName(spark.read.parquet(*old).filter(keep), allowMissingColumns=True)
        if touched:
            latest(rows, key, order).withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/rows/v={number}")
        after = now | dict.fromkeys(touched, number)
        spark.createDataFrame(list(after.items()), "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v={number}")
        for path in _buckets(table, {b: n for b, n in before.items() if now[b] != n}):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return run


def ingest_events(spark: SparkSession, sf_dir: str, cutoff: str) -> DataFrame:
    """Run the stream over what ``events`` holds now and return the table."""
    root = kept_path(spark, f"stream-{uuid.uuid4().hex}")
    keep = f"ts >= timestamp '{cutoff}'"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    sink = upsert_batch(f"{root}/table", "user_id", ["ts", "event_id"], keep)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = query.lastProgress["batchId"] if query.lastProgress else 0
    return read_table(spark, f"{root}/table", done, schema, keep).select("user_id", "event_id", "event_type")

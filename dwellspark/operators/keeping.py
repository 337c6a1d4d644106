"""Tables that are kept across runs: chunks written once, embeddings computed once a text, and counts of a plan's stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def write_chunks(df: DataFrame, path: str, chunk: Column) -> DataFrame:
    """Write ``df`` in chunks below ``path``, and return the manifest: chunk, rows.

    A chunk is finished once the manifest names it; finished ones are skipped, so only the rest
    of the rows is computed.  Rows go first, into a folder of the run's own, then the manifest,
    which says in whose folder a chunk is: what a run that stops in between has left is never
    read, and the next run writes it again.  Chunks are a column, not folders, so that a run's
    files grow with its tasks and not with its chunks.
    """
    spark = df.sparkSession
    rows = df.withColumn("chunk", chunk.cast("long"))
    done = _read(spark, f"{path}/manifest")
    if done is not None:
        rows = rows.join(done.select("chunk"), "chunk", "left_anti")
    run = uuid.uuid4().hex
    rows.repartition("chunk").write.parquet(f"{path}/runs/run={run}")
    there = spark.read.schema(rows.schema).parquet(f"{path}/runs/run={run}")
    new = there.groupBy("chunk").agg(F.count("*").alias("rows"), F.lit(run).alias("run"))
    new.write.mode("append").parquet(f"{path}/manifest")
    return spark.read.schema(new.schema).parquet(f"{path}/manifest").select("chunk", "rows")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of finished chunks."""
    return spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs").join(spark.read.parquet(f"{path}/manifest").select("chunk", "run"), ["chunk", "run"], "left_semi").drop("run")


def embedded_once(texts: DataFrame, path: str, embed: Callable[[Column], Column], *, text: str = "text") -> tuple[DataFrame, int]:
    """``texts`` with ``vector``, and how many texts were computed: those whose hash is not in the store at ``path`` yet.

    The store has a row for each distinct text, by its SHA-256, whatever table it came from.
    """
    spark = texts.sparkSession
    own = texts.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    missing = own.groupBy("hash").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    store = _read(spark, path)
    before = 0
    if store is not None:
        before = store.count()
        missing = missing.join(store.select("hash"), "hash", "left_anti")
    missing.select("hash", embed(F.col("said")).alias("vector")).write.mode("append").parquet(path)
    store = spark.read.parquet(path)
    return own.join(store, "hash").drop("hash"), store.count() - before


def expire(spark: SparkSession, path: str, used: DataFrame, *, text: str = "text") -> None:
    """Leave only the hashes of ``used`` texts in the store; what stays is written beside it first, and read from there."""
    keep = used.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash")).distinct()
    spark.read.parquet(path).join(keep, "hash", "left_semi").write.mode("overwrite").parquet(f"{path}-kept")
    spark.read.parquet(f"{path}-kept").write.mode("overwrite").parquet(path)


class Stages:
    """Counts of rows at stages of a plan, taken while the plan runs once."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def count(self, df: DataFrame, name: str) -> DataFrame:
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """The counts, once the plan has run."""
        return {name: o.get["n"] for name, o in self.seen.items()}

"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't find it themselves (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_dwellspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="dwellspark-code-")) / "dwellspark_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._dwellspark_shipped = True


def kept_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``; one of our own where it is unset, on one machine only)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("dwellspark.kept.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='dwellspark-')}"
        spark.conf.set("dwellspark.kept.dir", root)
    return f"{root.rstrip('/')}/dwellspark/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, and read back; several parts of a plan then read it without computing it again."""
    path = kept_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

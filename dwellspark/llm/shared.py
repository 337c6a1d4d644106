"""Tables in the folder that the driver and every executor share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back, so that a lost executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("dwellspark.shared.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='dwellspark-')}"
        spark.conf.set("dwellspark.shared.dir", root)
    return root


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/dwellspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return it read back, and its path."""
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Packed:
    """A table's rows as one struct column ``row``, so that no other column can clash with theirs.

    Fields are numbered, as names may differ in case alone from a working column's.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        numbered = docs.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.rows = numbered.select(F.struct(*numbered.columns).alias("row"))

    def index(self, name: str) -> int:
        """The column of this name, or else of this name in another case."""
        if name in self.names:
            return self.names.index(name)
        same = [i for i, x in enumerate(self.names) if x.lower() == name.lower()]
        if len(same) != 1:
            raise ValueError(f"no single column {name} among {self.names}")
        return same[0]

    def field(self, name: str) -> Column:
        return F.col("row")[f"c{self.index(name)}"]

    def unpack(self, df: DataFrame, **changed: Column) -> DataFrame:
        """The table's columns out of ``row``, some of them replaced."""
        other = {self.index(k): v for k, v in changed.items()}
        return df.select(*(other.get(i, F.col("row")[f"c{i}"]).alias(f"c{i}") for i in range(len(self.names)))).toDF(*self.names)

    def unpack_with(self, df: DataFrame, **added: Column) -> DataFrame:
        """The same and further columns, which replace those of their names."""
        taken = {k.lower() for k in added}
        kept = [i for i, x in enumerate(self.names) if x.lower() not in taken]
        columns = [F.col("row")[f"c{i}"].alias(f"c{i}") for i in kept] + [v.alias(f"a{j}") for j, v in enumerate(added.values())]
        return df.select(*columns).toDF(*(self.names[i] for i in kept), *added)

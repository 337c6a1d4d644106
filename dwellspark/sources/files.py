"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

#: A listing as crawled; polymorphic fields are text.
LISTING = T.StructType(
    [T.StructField(n, _S) for n in ("source", "url", "listing_id", "scraped_at", "address", "postcode", "postcode_district", "title", "added_date")]
    + [T.StructField(n, _I) for n in ("price_pcm", "price_pw")]
    + [T.StructField(n, _S) for n in ("price_display", "deposit")]
    + [T.StructField("deposit_amount", _I)]
    + [T.StructField(n, _S) for n in ("available_from", "min_tenancy", "let_type", "furnish_type", "council_tax", "property_type", "bedrooms", "bathrooms", "size_sqft", "size_sqm", "description", "features")]
    + [T.StructField(n, _D) for n in ("latitude", "longitude")]
    + [T.StructField("image_url", _S), T.StructField("image_urls", T.ArrayType(_S)), T.StructField("stations", _S), T.StructField("schools", _S), T.StructField("max_tenants", _I)]
    + [T.StructField(n, _B) for n in ("bills_included", "student_friendly", "families_allowed", "pets_allowed", "smokers_allowed", "dss_covers_rent", "garden", "parking", "fireplace", "online_viewings")]
    + [T.StructField("epc_rating", _S)]
)


def read_listings(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """JSON lines with the listing schema; malformed lines are skipped, or (``strict``) raise."""
    return spark.read.schema(LISTING).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_listings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def latest_run(spark: SparkSession, root: str, prefix: str = "run_") -> str | None:
    """The last of the folders named prefix*, by name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    found = [s.getPath() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base) if s.isDirectory()]
    names = sorted(p.toString() for p in found if p.getName().startswith(prefix))
    return names[-1] if names else None


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and comments are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def append_log(df: DataFrame, path: str, limit: int = 320) -> None:
    """Audit rows as JSON lines, long texts cut."""
    cut = [F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cut).write.mode("append").json(path)

"""The same column functions over streams; state is Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.urls import Url
from ..operators.links import with_url


def url_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    """New files under ``path`` as a stream with the parsed URL ``u``."""
    return with_url(spark.readStream.schema(schema).format(kind).load(path))


def hosts_by_window(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Rows by host and time window; rows later than ``late`` are left out, as a watermark does."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), Url("u").raw_host.alias("host")).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Each URL once within the watermark, by its equality key."""
    return stream.withColumn("key", Url("u").key).withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])

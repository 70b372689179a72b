"""Tables of URLs from files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import Url
from ..operators.links import with_url


def read_urls(spark: SparkSession, path: str, kind: str = "text", column: str | None = None, **options: str) -> DataFrame:
    """Files of any kind that Spark reads as a table with a column ``url``; text files have a URL a line."""
    df = spark.read.format(kind).options(**options).load(path)
    return df.withColumnRenamed(column or ("value" if kind == "text" else "url"), "url")


def parsed_and_rejected(df: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """The rows that are URLs, with the struct ``u``; and the others, with the error's code."""
    told = with_url(df, url).withColumn("error", Url.error(url))
    return told.where("u is not null").drop("error"), told.where("u is null").drop("u")


def write_urls(df: DataFrame, path: str, kind: str = "parquet", name: str = "u") -> None:
    """Write the URLs of a struct column as strings, with the other columns."""
    df.withColumn("url", Url(name).text).drop(name).write.format(kind).save(path)


def as_json(df: DataFrame, name: str = "u") -> DataFrame:
    """The struct column as JSON text: its five parts."""
    return df.withColumn(name, F.to_json(name))

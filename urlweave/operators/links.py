"""Operations on tables of URLs: parsing a column, roll-ups, query parameters, distinct URLs, the link graph.

All shuffles are by the user's keys: a host roll-up and a distinct aggregate before they shuffle, so a host with
a third of all rows costs a task one row for each task before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import Url
from ..schema import URL_METADATA
from ..session import ship

#: Rows of a table of short rows that one task works on: some seconds of URL expressions.
SPREAD_ROWS = 10_000

#: Tasks that a table is dealt over at most.
SPREAD_TASKS = 20_000

HREF = r"""href\s*=\s*["']([^"'<>]*)["']"""


def with_url(df: DataFrame, url: str | Column = "url", name: str = "u", strict: bool = False) -> DataFrame:
    """``df`` with the parsed URL as a struct column; null where there is none, unless strict. The schema marks it as a URI."""
    ship(df.sparkSession)
    return df.withColumn(name, Url.parse(url, strict=strict).col).withMetadata(name, URL_METADATA)


def spread(df: DataFrame) -> DataFrame:
    """``df``, for tables of short rows: dealt evenly over tasks of SPREAD_ROWS rows, or over all cores if these would get less.

    A file's splits go by bytes and row groups, so millions of short rows can come in one task, and a URL's expressions
    take far more time than its bytes. Rows are counted, which takes the files' footers alone.
    """
    rows = df.count()
    cores = min(df.sparkSession.sparkContext.defaultParallelism, rows // (SPREAD_ROWS // 10))
    return df.repartition(max(1, cores, min(SPREAD_TASKS, -(-rows // SPREAD_ROWS))))


def host_rollup(df: DataFrame, name: str = "u") -> DataFrame:
    """Rows, and the share of https, by host."""
    u = Url(name)
    told = df.select(u.raw_host.alias("host"), (u.scheme == "https").cast("double").alias("secure"))
    return told.groupBy("host").agg(F.count("*").alias("n_pages"), F.avg("secure").alias("https_share"))


def query_parameters(df: DataFrame, name: str = "u", *keep: str) -> DataFrame:
    """A row for each parameter of each URL: the columns to keep, position, key, value."""
    return df.select(*keep, F.posexplode(Url(name).query).alias("position", "p")).select(*keep, "position", "p.key", "p.value")


def distinct_urls(df: DataFrame, name: str = "u") -> DataFrame:
    """Each URL once, by its equality key."""
    return df.select(Url(name).key.alias(name)).distinct()


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each link of each page: the columns to keep, href, and the target resolved against the page's URL."""
    found = pages.select(*keep, url, F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("href"))
    both = with_url(with_url(found, url, "base"), "href", "ref")
    return both.select(*keep, "href", Url("base").join(Url("ref")).col.alias("target"))


def link_graph(pages: DataFrame) -> DataFrame:
    """Links and linking pages by target host."""
    links = page_links(pages).select("page_id", Url("target").raw_host.alias("host"))
    # Two levels: a page counts once for a host, and neither level gathers a host's rows in one task.
    per_page = links.groupBy("host", "page_id").agg(F.count("*").alias("links"))
    return per_page.groupBy("host").agg(F.sum("links").alias("in_links"), F.count("*").alias("in_pages"))


def ranked_hosts(df: DataFrame, name: str = "u") -> DataFrame:
    """Hosts with their rank by rows. Only the distinct numbers of rows are ordered in one place: as many as the square root of twice the rows."""
    rolled = host_rollup(df, name)
    sizes = rolled.groupBy("n_pages").agg(F.count("*").alias("hosts"))
    before = Window.orderBy(F.desc("n_pages")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("n_pages", (F.coalesce(F.sum("hosts").over(before), F.lit(0)) + 1).cast("int").alias("rank"))
    return rolled.join(ranks, "n_pages").select("host", "n_pages", "rank")

"""Every query of the catalog against its SQL, and the stream functions."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from urlweave.functions.urls import Url
from urlweave.operators import links
from urlweave.plans import catalog
from urlweave.sources.urls import as_json, parsed_and_rejected, read_urls, write_urls
from urlweave.streaming import hosts as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", ["more_edits", "raw_accessors", "authority_edits", "resolved_references", "built_urls", "url_text"])
def test_rows_of_one_file_fall_to_many_tasks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(links, "SPREAD_ROWS", 20)
    for table in ("customer", "part", "pages"):
        d = spark.read.parquet(f"{SF}/{table}.parquet")
        d.unionByName(d).coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
    made = catalog.queries()[name](spark, f"file://{tmp_path}")
    sizes = [r["count"] for r in made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    n = spark.read.parquet(f"file://{tmp_path}/{'part' if name == 'built_urls' else 'pages' if name == 'url_text' else 'customer'}.parquet").count()
    assert n >= 100 and sum(sizes) == n and max(sizes) <= 25


def test_spread_of_nothing_and_of_few(spark):
    assert links.spread(spark.range(0)).collect() == []
    assert sorted(r[0] for r in links.spread(spark.range(7)).collect()) == list(range(7))


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a/x\nhttp://:1\nhttp://b:80/?q=1\n")
    good, bad = parsed_and_rejected(read_urls(spark, f"file://{tmp_path}/urls.txt"))
    assert [tuple(r) for r in bad.collect()] == [("http://:1", "HOST_REQUIRED")]
    write_urls(good.select("u"), f"file://{tmp_path}/out")
    assert sorted(r[0] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["http://a/x", "http://b/?q=1"]
    assert '"netloc":"a"' in sorted(r[0] for r in as_json(good.select("u")).collect())[0]


def test_streams(spark, tmp_path):
    rows = [(f"http://h{k % 2}/{k % 3}", k * 60) for k in range(12)]
    d = spark.createDataFrame(rows, "url string, s long").select("url", F.timestamp_seconds("s").alias("ts"))
    d.write.parquet(f"file://{tmp_path}/in")
    stream = H.url_stream(spark, f"file://{tmp_path}/in", d.schema)
    q = H.hosts_by_window(stream, "ts").writeStream.format("memory").queryName("by_window").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["host"], r["window"]["start"].minute): r["n"] for r in spark.table("by_window").collect()}
    assert got == {("h0", 0): 3, ("h1", 0): 2, ("h0", 5): 2, ("h1", 5): 3, ("h0", 10): 1, ("h1", 10): 1}
    q = H.first_seen(stream, "ts").writeStream.format("memory").queryName("first_seen").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_seen").count() == 6


def test_null_and_empty_tables(spark):
    d = links.with_url(spark.createDataFrame([(None,), ("http://h/?a=1",), ("http://h/?a=1",)], "url string"))
    assert d.schema["u"].metadata == {"format": "uri"}
    assert links.host_rollup(d).count() == 2
    assert links.query_parameters(d).count() == 2
    assert links.distinct_urls(d.where("u is not null")).count() == 1
    empty = links.with_url(d.drop("u").limit(0))
    assert links.host_rollup(empty).collect() == []
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/", "no links"), (3, None, '<a href="/x">')], "page_id bigint, url string, html string")
    assert [tuple(r) for r in links.page_links(pages).select("page_id", Url("target").text).collect()] == [(3, None)]


def test_no_oracle_names_a_row_limit():
    assert not any(re.search(r"\blimit\b", q, re.I) for q in catalog.oracle_sql().values())

from urlweave.functions.register import register


def test_sql_names(spark):
    register(spark)
    spark.createDataFrame([(1, "a=1&b+c=%20%zz&d"), (2, ""), (3, None)], "k int, q string").createOrReplaceTempView("queries")
    got = spark.sql("SELECT k, position, key, value FROM queries, LATERAL url_query_pairs(q) ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", "1"), (1, 1, "b c", " %zz"), (1, 2, "d", "")]
    row = spark.sql("SELECT url_encode_host('Bücher.de') AS a, url_decode_host('xn--bcher-kva.de') AS b, url_human_quote('a#%é', '#') AS c, url_encode_host('A.b') AS d").first()
    assert tuple(row) == ("xn--bcher-kva.de", "bücher.de", "a%23%25é", "a.b")

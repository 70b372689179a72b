"""SQL names for what SQL text needs most: host coding, human quoting, and query pairs as a table.

In SQL text: ``url_encode_host(host)``, ``url_decode_host(host)``, ``url_human_quote(text, unsafe)``,
and ``FROM pages, LATERAL url_query_pairs(query)``. All else is a column expression: give a
DataFrame its URL columns, then ``createOrReplaceTempView``. All but the hosts are SQL functions, without Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..session import ship
from . import codec
from .hosts import coded_name, readable_name
from .urls import UNPRINTABLE

_CLASS = rf"concat(regexp_replace(concat('%', unsafe), r'([^A-Za-z0-9])', r'\\$1'), r'{UNPRINTABLE}')"
_PLAIN = rf"array_join(transform(regexp_extract_all({{}}, r'(?:{codec.WELL_FORMED})|[^%]+|%', 0), p -> if(length(p) > 1 and startswith(p, '%'), decode(unhex(replace(p, '%', '')), 'UTF-8'), replace(p, '+', ' '))), '')"

FUNCTIONS = [
    f"""url_human_quote(text STRING, unsafe STRING) RETURNS STRING RETURN array_join(transform(
        regexp_extract_all(text, concat('[', {_CLASS}, ']|[^', {_CLASS}, ']+'), 0),
        x -> if(regexp_like(x, concat('[', {_CLASS}, ']')), regexp_replace(hex(encode(x, 'UTF-8')), '(..)', '%$1'), x)), '')""",
    f"""url_query_pairs(query STRING) RETURNS TABLE (position INT, key STRING, value STRING) RETURN
        SELECT pos, {_PLAIN.format("substring_index(col, '=', 1)")}, {_PLAIN.format("if(instr(col, '=') > 0, substring(col, instr(col, '=') + 1), '')")}
        FROM posexplode(if(query <> '', split(query, '&'), array()))""",
]


@pandas_udf(StringType())
def _encode(host: pd.Series) -> pd.Series:
    """A name's coded form, names in ASCII in lower case; null if there is none."""
    return pd.Series([None if h is None else h.lower() if h.isascii() else coded_name(h) for h in host], dtype=object)


@pandas_udf(StringType())
def _decode(host: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else readable_name(h) for h in host], dtype=object)


def register(spark: SparkSession) -> None:
    """Register the functions in a session."""
    ship(spark)
    spark.udf.register("url_encode_host", _encode)
    spark.udf.register("url_decode_host", _decode)
    for function in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")

"""URL filters: rules indexed by their rarest literal token.

A rule is ``(action, host, path)``. It fits its host and all subdomains if the URL's path starts with the
rule's path. Every rule has literal tokens that a fitting URL must hold as whole tokens: all labels of its
host, and the path segments that the rule closes with a slash. The rule is filed under the one of them that
the URLs hold least often; a URL looks up the rules of its own tokens, and only those run as regular
expressions. Of the rules that fit, the longest wins (host and path characters; then by text, block before
allow).

Two plans give the same rows. Up to ``MAP_RULES`` rules the index is a map literal and a URL is judged inside
one projection, without a shuffle. Beyond that, the tokens of the distinct (host, path) pairs are joined to
the rule table, and verdicts are joined back.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty rule
host or path is an error; repeated rows are judged alike; an empty table gives an empty table; further
columns pass through, and existing columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

Rule = tuple[str, str, str]

#: Rules up to this number are held as a map literal in the plan.
MAP_RULES = 256

#: What a URL gets that no rule fits.
DEFAULT_VERDICT = "allow"

PRODUCTION_RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def rule_tokens(host: str, path: str) -> list[str]:
    """Literal tokens that any fitting URL holds whole: host labels, and path segments closed by a slash."""
    return [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in path.split("/")[:-1] if x]


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, in the form of ``rule_tokens``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def rule_regex(host: str, path: str) -> str:
    """What decides whether a rule fits, over host, a NUL and path."""
    return r"^(?:[^\x00]*\.)?" + _escaped(host) + r"\x00" + _escaped(path)


def _escaped(text: str) -> str:
    return "".join(x if re.match(r"[A-Za-z0-9/_]", x) else f"\\x{{{ord(x):x}}}" for x in text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``."""
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    return (lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def token_counts(parts: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; the result is bounded by the rules, not the URLs."""
    held = parts.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).where(F.col("token").isin(wanted))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = DEFAULT_VERDICT, map_rules: int = MAP_RULES) -> DataFrame:
    """``urls`` with host, path, rule and verdict; see the module's text for the cases."""
    rules = sorted({(action, lower(host), path) for action, host, path in rules})
    if any(not host or not path.startswith("/") or action not in ("block", "allow") for action, host, path in rules):
        raise ValueError("a rule is (block or allow, host, path that starts with a slash)")
    host, path = host_and_path(F.col(url_col))
    parts = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    wanted = sorted({t for _, h, p in rules for t in rule_tokens(h, p)})
    counts = token_counts(parts, wanted)
    filed = [(min(rule_tokens(h, p), key=lambda t: (counts.get(t, 0), t)), rule_regex(h, p), len(h + p), h + p, action) for action, h, p in rules]
    judged = _by_map(parts, filed) if len(filed) <= map_rules else _by_join(parts, filed)
    return judged.withColumns({"rule": F.col("_won.rule"), "verdict": F.coalesce(F.col("_won.verdict"), F.lit(default))}).drop("_won")


def lower(host: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), host)


def _by_map(parts: DataFrame, filed: list[tuple]) -> DataFrame:
    """One projection: the URL's tokens fetch candidate rules from a map literal; the fitting one that ranks last wins."""
    index: dict[str, list[Column]] = {}
    for token, regex, size, rule, action in filed:
        index.setdefault(token, []).append(F.struct(F.lit(size).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("verdict"), F.lit(regex).alias("regex")))
    entries = F.create_map(*(x for token, found in index.items() for x in (F.lit(token), F.array(*found))))
    held = F.filter(url_tokens(F.col("host"), F.col("path")), lambda t: F.map_contains_key(entries, t))
    candidates = F.flatten(F.transform(held, lambda t: F.try_element_at(entries, t)))
    subject = F.concat("host", F.lit("\0"), "path")
    return parts.withColumn("_won", F.array_max(F.filter(candidates, lambda r: F.regexp_like(subject, r["regex"]))))


def _by_join(parts: DataFrame, filed: list[tuple]) -> DataFrame:
    """The tokens of distinct (host, path) pairs join the rules; the best fitting rule is joined back."""
    spark = parts.sparkSession
    rules = spark.createDataFrame(filed, "token string, regex string, size int, rule string, verdict string")
    pairs = parts.select("host", "path").distinct()
    tokens = pairs.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    fits = tokens.join(rules, "token").where(F.regexp_like(F.concat("host", F.lit("\0"), "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("_won"))
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, "_won")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), PRODUCTION_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
    FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

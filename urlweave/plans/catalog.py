"""The queries over the driver's tables and the SQL that each is held against.

The tables' own URLs are plain, so several queries put harder ones together from columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions.urls import Url, normalize_path
from ..operators import links
from ..session import ship

U = Url("u")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Short columns of a table, dealt evenly over tasks."""
    return links.spread(_table(spark, sf_dir, name).select(*columns))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.with_url(_rows(spark, sf_dir, "pages", "page_id", "url"))


def hosts_by_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the share of https by host."""
    return links.host_rollup(_pages(spark, sf_dir))


def host_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.ranked_hosts(_pages(spark, sf_dir))


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and linking pages by target host."""
    return links.link_graph(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, resolved."""
    found = links.page_links(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "href", Url("target").raw_host.alias("host"), C.UNQUOTER(Url("target").raw_path).alias("path"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every page's URL."""
    return _pages(spark, sf_dir).select("page_id", U.scheme.alias("scheme"), U.host.alias("host"), U.explicit_port.alias("explicit_port"), U.port.alias("port"), U.path.alias("path"), U.query_string.alias("query_string"), U.fragment.alias("fragment"), U.absolute.alias("is_absolute"), U.is_default_port.alias("is_default_port"))


def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path segments, names and suffixes."""
    return _pages(spark, sf_dir).select("page_id", F.size(U.parts).alias("n_parts"), U.name.alias("name"), U.suffix.alias("suffix"), U.parent.text.alias("parent"), U.origin.text.alias("origin"), U.relative.text.alias("relative"))


def url_query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query parameter."""
    return links.query_parameters(_pages(spark, sf_dir), "u", "page_id")


def url_query_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a parameter, with one more, with one replaced, and new."""
    return _pages(spark, sf_dir).select("page_id", U.without_query_params("utm_source", "ref").raw_query_string.alias("without"), U.extend_query(id=F.col("page_id")).raw_query_string.alias("extended"), U.update_query({"page": "0"}).raw_query_string.alias("updated"), U.with_query({"a": [1, 2], "b": "x y"}).raw_query_string.alias("replaced"))


def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs by host once query and fragment are gone; "" and "/" are one path."""
    bare = _pages(spark, sf_dir).withColumn("u", U.with_query(None).with_fragment(None).col)
    return links.distinct_urls(bare).groupBy(U.raw_host.alias("host")).agg(F.count("*").alias("n_urls"))


def url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs rendered again, for machines and for people."""
    return _pages(spark, sf_dir).select("page_id", U.text.alias("text"), U.human_repr.alias("human"), U.repr.alias("repr"))


def _harder(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    url = F.concat(F.lit("HTTP://U%20ser:p%40@Shop"), F.col("c_custkey"), F.lit(".Example.COM:80/a/./b/../"), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("/x y?q="), F.col("c_mktsegment"), F.lit("&r=%2b%20+#f%41 g"))
    return links.with_url(customers.withColumn("url", url))


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that need every step of canonicalising."""
    return _harder(spark, sf_dir).select("c_custkey", U.text.alias("text"), U.user.alias("user_name"), U.password.alias("secret"), U.raw_authority.alias("raw_authority"), U.query_get("r").alias("r"))


def authority_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes, users, hosts, ports and fragments replaced."""
    d = _harder(spark, sf_dir)
    return d.select("c_custkey", U.with_scheme("https").raw_authority.alias("secure"), U.with_user(F.lower("c_mktsegment")).with_port(8080).raw_authority.alias("other"), U.with_user(None).raw_authority.alias("anonymous"), U.with_host(F.concat(F.lit("H"), F.col("c_custkey"))).raw_authority.alias("moved"), U.with_fragment(None).raw_fragment.alias("no_fragment"))


def path_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths extended and replaced."""
    u = U
    d = _harder(spark, sf_dir)
    return d.select("c_custkey", (u / "z z").raw_path.alias("child"), u.joinpath("..", "up").raw_path.alias("sibling"), u.with_name("n.txt").raw_path.alias("named"), u.with_name("n.txt").with_suffix(".md").raw_path.alias("suffixed"), u.with_path("p/../q").raw_path.alias("pathed"))


def built_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs put together from columns."""
    parts = _rows(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    made = Url.build(scheme="https", host="parts.example", port=F.col("p_size") + 8000, path=F.concat(F.lit("/"), F.col("p_name")), query={"key": F.col("p_partkey"), "n": F.col("p_name")})
    return parts.select("p_partkey", made.col.alias("u")).select("p_partkey", U.text.alias("text"))


def quoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts percent-encoded, and decoded again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("quoted", C.QUOTER(F.col("text")))
    return docs.select("doc_id", F.sha2("quoted", 256).alias("quoted_sha256"), C.UNQUOTER(F.col("quoted")).eqNullSafe(F.col("text")).alias("round_trip"))


def folded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot segments folded."""
    path = F.concat(F.lit("/"), F.col("c_name"), F.lit("/../"), F.col("c_nationkey"), F.lit("/./x/../../../"), F.col("c_custkey"), F.lit("/."))
    return _rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").select("c_custkey", normalize_path(path).alias("path"))


def _turn(values: list[str]) -> Column:
    """One of the values for each customer, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))


#: What follows "http://", and the error's code; "" for a URL.
_WRONG = [
    ("h:99999/", "PORT_RANGE"), ("h:x/", "BAD_PORT"), (":80/", "HOST_REQUIRED"), ("[::1]evil/", "INVALID_IPV6"), ("ok.example/", ""), ("a\\b/", "BACKSLASH_IN_AUTHORITY"),
    ("[abc]/", "BRACKET_NOT_IPV6"), ("[v1/", "INVALID_IPV6"), ("[vz.a]/", "INVALID_IPVFUTURE"), ("u@/", "HOST_REQUIRED"), ("h:65535/", ""), ("h:65536/", "PORT_RANGE"),
    ("ex\u2100mple/", "NFKC_DELIMITER"), ("a\u200bb.example/", "HOST_DEFAULT_IGNORABLE"),
]


def url_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why strings are no URLs."""
    url = F.concat(F.lit("http://"), _turn([x for x, _ in _WRONG]), F.col("c_custkey"))
    d = _rows(spark, sf_dir, "customer", "c_custkey").select("c_custkey", url.alias("url")).withColumn("error", Url.error("url"))
    return d.select("c_custkey", "error", F.col("error").isNull().alias("is_valid"))


#: A host as written, raw, for people, and in an authority.
_HOSTS = [
    ("b\u00fccher.example", "xn--bcher-kva.example", "b\u00fccher.example", "xn--bcher-kva.example"),
    ("\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444", "xn--e1afmkfd.xn--p1ai", "\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444", "xn--e1afmkfd.xn--p1ai"),
    ("[2001:DB8:0:0::1]", "2001:db8::1", "2001:db8::1", "[2001:db8::1]"),
    ("[fe80::1%25eth0]", "fe80::1%25eth0", "fe80::1%eth0", "[fe80::1%25eth0]"),
    ("fa\u00df.de", "xn--fa-hia.de", "fa\u00df.de", "xn--fa-hia.de"),
    ("[0:0:1:0:0:0:0:1]", "0:0:1::1", "0:0:1::1", "[0:0:1::1]"),
    ("[::FFFF:192.0.2.1]", "::ffff:192.0.2.1", "::ffff:192.0.2.1", "[::ffff:192.0.2.1]"),
    ("192.0.2.33", "192.0.2.33", "192.0.2.33", "192.0.2.33"),
    ("ASCII.Example", "ascii.example", "ascii.example", "ascii.example"),
    ("\uff41\uff42.example", "ab.example", "ab.example", "ab.example"),
]


def international_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that must be coded: IDNA, IPv6 and zones."""
    d = links.with_url(_rows(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("http://"), _turn([h[0] for h in _HOSTS]), F.lit("/"), F.col("c_custkey")).alias("url")))
    return d.select("c_custkey", U.raw_host.alias("raw_host"), U.host.alias("host"), U.host_subcomponent.alias("host_subcomponent"), U.host_port_subcomponent.alias("host_port"))


def raw_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors of parts as they are coded, and of decoded ones beside them."""
    customers = _rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    url = F.concat(F.lit("http://U%20ser:p%40@Shop"), F.col("c_custkey"), F.lit(".Example.COM:8080/a b/"), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("/f%2fg%25.tar.gz?q="), F.col("c_mktsegment"), F.lit("&r=%2b#f%41 g"))
    d = links.with_url(customers.withColumn("url", url))
    joined = lambda x: F.array_join(x, "|")
    return d.select(
        "c_custkey", U.raw_user.alias("raw_user"), U.raw_password.alias("raw_password"), U.authority.alias("authority"), U.host_subcomponent.alias("host_subcomponent"), U.host_port_subcomponent.alias("host_port"), U.explicit_port.alias("explicit_port"), U.is_default_port.alias("is_default_port"),
        U.raw_path.alias("raw_path"), U.path.alias("path"), U.path_safe.alias("path_safe"), U.path_qs.alias("path_qs"), U.raw_path_qs.alias("raw_path_qs"), joined(U.raw_parts).alias("raw_parts"), joined(U.parts).alias("parts"),
        U.raw_name.alias("raw_name"), U.name.alias("name"), U.raw_suffix.alias("raw_suffix"), joined(U.raw_suffixes).alias("raw_suffixes"), joined(U.suffixes).alias("suffixes"), U.raw_fragment.alias("raw_fragment"), U.fragment.alias("fragment"), U.truth.alias("truth"), F.decode(U.bytes, "US-ASCII").alias("ascii_bytes"),
    )


def more_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passwords, query updates of each kind, values that are doubles, pre-encoded URLs, human forms and order."""
    d = _harder(spark, sf_dir)
    verbatim = Url.parse(F.concat(F.lit("http://h/%zz a/"), F.col("c_custkey")), encoded=True).text
    coded = F.concat(F.lit("p"), F.col("c_custkey"), F.lit(":q"))
    return d.select(
        "c_custkey", U.with_password("s p").raw_authority.alias("with_password"), U.with_user(None).with_password("x").raw_authority.alias("password_alone"), (U % {"q": "1"}).raw_query_string.alias("by_percent"), U.with_query([("a", F.col("c_custkey")), ("a", "2 3")]).raw_query_string.alias("by_pairs"),
        U.update_query("q=n&z=" + "1").raw_query_string.alias("by_text"), U.extend_query({"d": (F.col("c_custkey") / 4).cast("double")}).raw_query_string.alias("by_double"), verbatim.alias("verbatim"), U.human_repr.alias("human"), Url.build(path=coded).text.alias("guarded"),
        (U.sort_key < U.with_scheme("https").sort_key).alias("before_https"), (U.with_path("/a").sort_key < U.with_path("/b").sort_key).alias("before_b"),
    )


def built_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs built from an authority, from users and hosts, and from coded parts."""
    parts = _rows(spark, sf_dir, "part", "p_partkey", "p_size")
    authority = F.concat(F.lit("U s:p@Host"), F.col("p_partkey"), F.lit(":8"), F.col("p_size"))
    by_authority = Url.build(scheme="http", authority=authority, path="/a b/../c")
    by_user = Url.build(scheme="ftp", user=F.concat(F.lit("u/"), F.col("p_partkey")), password="p:w", host="B\u00fccher.Example", port=21, path="/x")
    coded = Url.build(scheme="http", host="h", path=F.concat(F.lit("/%7e/"), F.col("p_partkey")), query_string="a=%20", encoded=True)
    return parts.select("p_partkey", by_authority.text.alias("by_authority"), by_user.text.alias("by_user"), coded.text.alias("coded"))


#: References, and what they are against http://a/b/c/d;p?q (RFC 3986, 5.4).
_REFERENCES = [
    ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("g;x?y#s", "http://a/b/c/g;x?y#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"), ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x"), ("g#s/../x", "http://a/b/c/g#s/../x"), ("g:h", "g:h"),
]


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every kind against one base."""
    d = _rows(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.lit("http://a/b/c/d;p?q").alias("base"), _turn([r for r, _ in _REFERENCES]).alias("ref"))
    both = links.with_url(links.with_url(d, "base", "b"), "ref", "r")
    return both.select("c_custkey", "ref", Url("b").join(Url("r")).text.alias("target"))


FLAGSHIP = link_graph

_CUT = r"regexp_extract(url, '^([A-Za-z0-9+.\-]+)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$', {})"
_SCHEME, _HOST, _PATH, _QUERY, _FRAGMENT = (_CUT.format(k) for k in (1, 2, 3, 5, 7))
_P = f"SELECT page_id, lower({_SCHEME}) AS scheme, lower({_HOST}) AS host, {_PATH} AS raw, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, {_QUERY} AS query, {_FRAGMENT} AS fragment, url FROM pages"
_SEGMENT = "CASE WHEN c_mktsegment IS NULL THEN NULL ELSE replace(c_mktsegment, ' ', '+') END"
_NAME = "replace(replace(c_name, '#', '%23'), ' ', '%20')"

def _picked(values: list[str]) -> str:
    """SQL of one of the values for each customer, in turn."""
    return "(" + "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]" + f")[c_custkey % {len(values)} + 1]"


ORACLES = {
    "hosts_by_pages": f"WITH p AS ({_P}) SELECT host, count(*) AS n_pages, avg(CASE WHEN scheme = 'https' THEN 1.0 ELSE 0.0 END)::DOUBLE AS https_share FROM p GROUP BY 1",
    "host_ranks": f"WITH p AS ({_P}), c AS (SELECT host, count(*) AS n_pages FROM p GROUP BY 1) SELECT host, n_pages, rank() OVER (ORDER BY n_pages DESC)::INTEGER AS rank FROM c",
    "resolved_links": f"WITH p AS (SELECT x.*, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM ({_P}) x JOIN pages USING (page_id)) SELECT page_id, href, host, CASE WHEN starts_with(href, '/') THEN href END AS path FROM p",
    "link_graph": f"WITH p AS (SELECT x.*, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM ({_P}) x JOIN pages USING (page_id)) SELECT host, count(*) AS in_links, count(DISTINCT page_id) AS in_pages FROM p GROUP BY 1",
    "url_parts": f"WITH p AS ({_P}) SELECT page_id, scheme, host, NULL::INTEGER AS explicit_port, CASE scheme WHEN 'http' THEN 80 WHEN 'https' THEN 443 END AS port, path, query AS query_string, fragment, TRUE AS is_absolute, TRUE AS is_default_port FROM p",
    "url_names": f"WITH p AS ({_P}), n AS (SELECT *, string_split(substr(path, 2), '/') AS parts FROM p), m AS (SELECT *, parts[len(parts)] AS name FROM n) SELECT page_id, len(parts) + 1 AS n_parts, name, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix, scheme || '://' || host || CASE WHEN raw IN ('', '/') THEN raw ELSE regexp_replace(raw, '/[^/]*$', '') END AS parent, scheme || '://' || host AS origin, raw || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS relative FROM m",
    "url_query_pairs": f"WITH p AS ({_P}), e AS (SELECT page_id, string_split(query, '&') AS q FROM p WHERE query <> ''), r AS (SELECT page_id, unnest(q) AS kv, generate_subscripts(q, 1) - 1 AS position FROM e) SELECT page_id, position::INTEGER AS position, split_part(kv, '=', 1) AS key, split_part(kv, '=', 2) AS value FROM r",
    "url_query_edits": f"WITH p AS ({_P}), e AS (SELECT page_id, query, CASE WHEN query = '' THEN [] ELSE string_split(query, '&') END AS q FROM p) SELECT page_id, array_to_string(list_filter(q, lambda x: split_part(x, '=', 1) NOT IN ('utm_source', 'ref')), '&') AS without, CASE WHEN query = '' THEN '' ELSE query || '&' END || 'id=' || page_id AS extended, CASE WHEN len(list_filter(q, lambda x: split_part(x, '=', 1) = 'page')) > 0 THEN array_to_string(list_transform(q, lambda x: CASE WHEN split_part(x, '=', 1) = 'page' THEN 'page=0' ELSE x END), '&') ELSE CASE WHEN query = '' THEN '' ELSE query || '&' END || 'page=0' END AS updated, 'a=1&a=2&b=x+y' AS replaced FROM e",
    "distinct_urls": f"WITH p AS ({_P}) SELECT host, count(DISTINCT scheme || path) AS n_urls FROM p GROUP BY 1",
    "url_text": f"WITH p AS (SELECT *, scheme || '://' || host || CASE WHEN raw = '' AND (query <> '' OR fragment <> '') THEN '/' ELSE raw END AS a, CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS b FROM ({_P})) SELECT page_id, a || b AS text, scheme || '://' || host || path || b AS human, 'URL(''' || a || b || ''')' AS repr FROM p",
    "canonical_urls": f"SELECT c_custkey, 'http://U%20ser:p%40@shop' || c_custkey || '.example.com/a/' || {_NAME} || '/x%20y?q=' || {_SEGMENT} || '&r=%2B%20+#fA%20g' AS text, 'U ser' AS user_name, 'p@' AS secret, 'U%20ser:p%40@shop' || c_custkey || '.example.com:80' AS raw_authority, '+  ' AS r FROM customer",
    "authority_edits": "SELECT c_custkey, 'U%20ser:p%40@shop' || c_custkey || '.example.com:80' AS secure, lower(c_mktsegment) || ':p%40@shop' || c_custkey || '.example.com:8080' AS other, 'shop' || c_custkey || '.example.com:80' AS anonymous, 'U%20ser:p%40@h' || c_custkey || ':80' AS moved, '' AS no_fragment FROM customer",
    "path_edits": f"SELECT c_custkey, '/a/' || {_NAME} || '/x%20y/z%20z' AS child, '/a/' || {_NAME} || '/up' AS sibling, '/a/' || {_NAME} || '/n.txt' AS named, '/a/' || {_NAME} || '/n.md' AS suffixed, '/q' AS pathed FROM customer",
    "built_urls": "SELECT p_partkey, 'https://parts.example:' || (p_size + 8000) || '/' || replace(replace(p_name, '#', '%23'), ' ', '%20') || '?key=' || p_partkey || '&n=' || replace(replace(p_name, '#', '%23'), ' ', '+') AS text FROM part",
    "quoted_texts": "SELECT doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%24', '$'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%2C', ','), '%2B', '+'), '%26', '&'), '%3D', '='), '%3B', ';')) AS quoted_sha256, TRUE AS round_trip FROM documents",
    "folded_paths": "SELECT c_custkey, '/' || c_custkey || '/' AS path FROM customer",
    "url_errors": f"SELECT c_custkey, nullif({_picked([e for _, e in _WRONG])}, '') AS error, {_picked([e for _, e in _WRONG])} = '' AS is_valid FROM customer",
    "international_hosts": f"SELECT c_custkey, {_picked([h[1] for h in _HOSTS])} AS raw_host, {_picked([h[2] for h in _HOSTS])} AS host, {_picked([h[3] for h in _HOSTS])} AS host_subcomponent, {_picked([h[3] for h in _HOSTS])} AS host_port FROM customer",
    "raw_accessors": f"""WITH n AS (SELECT c_custkey AS k, c_name AS n, {_NAME} AS rn, c_mktsegment AS s, {_SEGMENT} AS rs FROM customer)
        SELECT k AS c_custkey, 'U%20ser' AS raw_user, 'p%40' AS raw_password, 'U ser:p@@shop' || k || '.example.com:8080' AS authority, 'shop' || k || '.example.com' AS host_subcomponent, 'shop' || k || '.example.com:8080' AS host_port, 8080 AS explicit_port, FALSE AS is_default_port,
        '/a%20b/' || rn || '/f%2Fg%25.tar.gz' AS raw_path, '/a b/' || n || '/f/g%.tar.gz' AS path, '/a b/' || n || '/f%2Fg%25.tar.gz' AS path_safe, '/a b/' || n || '/f/g%.tar.gz?q=' || s || '&r=%2B' AS path_qs, '/a%20b/' || rn || '/f%2Fg%25.tar.gz?q=' || rs || '&r=%2B' AS raw_path_qs,
        '/|a%20b|' || rn || '|f%2Fg%25.tar.gz' AS raw_parts, '/|a b|' || n || '|f/g%.tar.gz' AS parts, 'f%2Fg%25.tar.gz' AS raw_name, 'f/g%.tar.gz' AS name, '.gz' AS raw_suffix, '.tar|.gz' AS raw_suffixes, '.tar|.gz' AS suffixes, 'fA%20g' AS raw_fragment, 'fA g' AS fragment, TRUE AS truth,
        'http://U%20ser:p%40@shop' || k || '.example.com:8080/a%20b/' || rn || '/f%2Fg%25.tar.gz?q=' || rs || '&r=%2B#fA%20g' AS ascii_bytes FROM n""",
    "more_edits": f"""WITH n AS (SELECT c_custkey AS k, c_name AS n, {_NAME} AS rn, c_mktsegment AS s, {_SEGMENT} AS rs FROM customer)
        SELECT k AS c_custkey, 'U%20ser:s%20p@shop' || k || '.example.com:80' AS with_password, ':x@shop' || k || '.example.com:80' AS password_alone, 'q=1&r=%2B++' AS by_percent, 'a=' || k || '&a=2+3' AS by_pairs, 'q=n&r=%2B++&z=1' AS by_text,
        'q=' || rs || '&r=%2B%20+&d=' || (k / 4.0)::DOUBLE AS by_double, 'http://h/%zz a/' || k AS verbatim, 'http://U ser:p%40@shop' || k || '.example.com:80/a/' || replace(n, '#', '%23') || '/x y?q=' || s || '&r=%2B  #fA g' AS human, 'p' || k || '%3Aq' AS guarded, TRUE AS before_https, TRUE AS before_b FROM n""",
    "built_authorities": "SELECT p_partkey, 'http://U%20s:p@host' || p_partkey || ':8' || p_size || '/c' AS by_authority, 'ftp://u%2F' || p_partkey || ':p%3Aw@xn--bcher-kva.example/x' AS by_user, 'http://h/%7e/' || p_partkey || '?a=%20' AS coded FROM part",
    "resolved_references": f"SELECT c_custkey, {_picked([r for r, _ in _REFERENCES])} AS ref, {_picked([t for _, t in _REFERENCES])} AS target FROM customer",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [hosts_by_pages, host_ranks, resolved_links, link_graph, url_parts, url_names, url_query_pairs, url_query_edits, distinct_urls, url_text, canonical_urls, authority_edits, path_edits, built_urls, quoted_texts, folded_paths, url_errors, international_hosts, raw_accessors, more_edits, built_authorities, resolved_references]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

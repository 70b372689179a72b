import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from urlweave.llm import exact_dedup as E
from urlweave.llm import near_dedup as N
from urlweave.llm import order_minhash as O
from urlweave.llm import quality_crf as Q
from urlweave.llm import registry
from urlweave.llm import url_rules as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, result.fetchall()))


# URL rules


def test_rules_by_both_plans(spark):
    urls = ["http://a.net/x", "http://example.net/en/x", "http://sub.example.net/en/", "http://notexample.net/en/", "https://EXAMPLE.com/de/1?x#y", "http://example.com/dex/", "ftp://org/fr/z", "http://net", "http://net/", None, "no url", "x://y.org/fr/?q", "http://a.net?x/", "://net/"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = [sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in R.filter_urls(pages, R.PRODUCTION_RULES, map_rules=m).collect()) for m in (256, 0)]
    assert got[0] == got[1]
    assert [r[3] for r in got[0]] == ["net/", "example.net/en/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, "net/", None, None, "org/fr/", None, "net/"]
    assert R.filter_urls(pages.limit(0), R.PRODUCTION_RULES).collect() == []
    assert {r["verdict"] for r in R.filter_urls(pages, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        R.filter_urls(pages, [("block", "", "/")])


def test_rules_at_random(spark):
    r = random.Random(4)
    hosts, paths = ["a", "b.a", "c.b.a", "ab", "x-a", "c.a"], ["/", "/p/", "/p/q", "/p.q/"]
    rules = list({(r.choice(["block", "allow"]), r.choice(hosts), r.choice(paths)) for _ in range(14)})
    urls = [f"http://{r.choice(hosts + ['z', 'Z.A'])}{r.choice(['', '/', '/p/', '/p/q/r', '/p.q/', '/pxq/'])}{r.choice(['', '?a', '#b'])}" for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")

    def best(u):
        host, path = re.match(r".*?://([^/?#]*)([^?#]*)", u).groups()
        host = host.lower()
        fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    for m in (256, 0):
        got = {x["page_id"]: (x["rule"], x["verdict"]) for x in R.filter_urls(pages, rules, map_rules=m).collect()}
        assert got == {k: best(u) for k, u in enumerate(urls)}


# Exact dedup


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        words = r.integers(0, 2**63, (n, 4), dtype=np.uint64)
        h = E.PerfectHash.build(words)
        assert sorted(h.slots(words).tolist()) == list(range(n))
        again = E.PerfectHash.unpacked(h.packed())
        assert (again.slots(words) == h.slots(words)).all()
        assert again.slots(r.integers(0, 2**63, (50, 4), dtype=np.uint64)).max(initial=-1) < max(n, 1)


def test_64_bit_ids_stay_exact_beside_null_ids(spark, monkeypatch):
    monkeypatch.setattr(E, "BUCKET_KEYS", 2)
    big = 1 << 60
    rows = [(big + 3, "same text"), (big + 1, "sametext"), (big + 5, "same text"), (None, "x"), (None, "y"), (big + 7, "y"), (big + 9, None), (big + 8, " ")] + [(big + 100 + k, f"own {k}") for k in range(20)]
    schema = "doc_id bigint, text string"
    none = spark.createDataFrame([], schema)
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i))
    for old, new in ((none, rows), (rows, none), (rows[::2], rows[1::2])):
        frames = [x if x is none else spark.createDataFrame(x, schema) for x in (old, new)]
        got = {(r["doc_id"], r["text_sha256"]): r for r in E.exact_dedup(*frames).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            norm = "".join((t or "").split())
            r = got[i, hashlib.sha256(norm.encode()).hexdigest()]
            best = min(groups[norm], key=lambda g: (g[0], g[1], g[2] or 0))
            assert (r["keep_id"], r["group_size"], r["kept"]) == (best[2], len(groups[norm]), i == best[2])


def test_history_and_new_rows(spark):
    old = [(1, "a b"), (2, "a  b "), (9, None)]
    new = [(3, "ab"), (4, "a\tb\n  "), (5, "c"), (6, "c"), (None, "c  "), (7, ""), (4, "zz"), (4, "zz")]
    schema = "doc_id bigint, text string"
    got = E.exact_dedup(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    told = sorted(((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"], r["in_history"]) for r in got))
    assert told == sorted([(1, 4, 4, False, True), (2, 4, 4, False, True), (3, 4, 4, False, True), (4, 4, 4, True, True), (5, 0, 3, False, False), (6, 0, 3, False, False), (0, 0, 3, True, False), (7, 7, 2, True, True), (9, 7, 2, False, True), (4, 4, 2, True, False), (4, 4, 2, True, False)])
    none = spark.createDataFrame([], schema)
    assert E.exact_dedup(none, none).collect() == []
    assert E.exact_dedup(none, spark.createDataFrame(old, schema)).count() == 3


# Order MinHash


def points(text):
    return O.order_minhash(F.lit(text))


def by_definition(spark, u):
    """The points that each sample selects, from Spark's hashes of points alone."""
    n = len(u)
    if not n:
        return []
    rounds = min(O.ROUNDS, -(-O.ENTRIES // n))
    d = spark.createDataFrame([(i, x >> 32) for i, x in enumerate(u)], "i int, p bigint")
    hashed = d.crossJoin(spark.range(rounds).select(F.col("id").cast("int").alias("r"))).select("i", "r", F.xxhash64("p", "r")).collect()
    own = {(i, j): h for i, j, h in d.crossJoin(spark.range(O.SAMPLES).select(F.col("id").cast("int").alias("j"))).select("i", "j", F.xxhash64("p", F.lit("own"), "j")).collect()}
    rest = {j: [] for j in range(O.SAMPLES)}
    for i, r, h in hashed:
        rest[((h % 2**64) >> 32) % O.SAMPLES].append((r, h % 2**24, i))
    out = []
    for j in range(O.SAMPLES):
        order = [i for _, _, i in sorted(rest[j])] + sorted(range(n), key=lambda i: (own[i, j], i))
        picked = list(dict.fromkeys(order))[: O.PICK]
        out.append([u[i] >> 32 for i in sorted(picked, key=lambda i: u[i] & 0xFFFFFFFF)])
    return out


@pytest.mark.parametrize("text", ["a b c d e f g a b c d e h i j k l m n o p a b c d e", "one", "a b c d e f", "a b c d e f g", " ".join(f"w{k * k % 700}" for k in range(1500)), ""])
def test_fingerprint_by_definition(spark, text):
    row = spark.range(1).select(O.numbered(O.kmer_hashes(F.lit(text))).alias("u"), points(text).alias("f"), O.kmer_hashes(F.lit(text)).alias("k")).first()
    assert len(row["u"]) == len(row["k"]) == len(set(row["u"])) == len({x >> 32 for x in row["u"]})
    want = by_definition(spark, row["u"])
    assert len(row["f"]) == (O.SAMPLES if text else 0)
    if text:
        d = spark.createDataFrame([(w,) for w in want], "w array<bigint>")
        assert [r[0] for r in d.select(F.xxhash64("w").bitwiseAND(F.lit(0xFFFFFFFF))).collect()] == list(row["f"])


def test_samples_scatter_as_independent_ones(spark):
    """Samples of short texts that share half of their k-mers agree as often as independent draws would, and scatter no more."""
    r = random.Random(11)
    rows = []
    for k in range(250):
        own = lambda side, m: [f"{side}{k}_{i}_{r.random()}" for i in range(m)]  # noqa: B023, E731
        both = own("s", 24)
        rows.append((" ".join(both + own("a", 10)), " ".join(both + own("b", 10))))
    d = spark.createDataFrame(rows, "a string, b string")
    same = F.aggregate(F.zip_with(O.order_minhash(F.col("a")), O.order_minhash(F.col("b")), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    p = np.array([x[0] for x in d.select(same).collect()]) / O.SAMPLES
    # 20 of 40 k-mers in common; pairs of minimal ones: 20 * 19 / (40 * 39)
    share = 20 * 19 / (40 * 39)
    assert abs(p.mean() - share) < 0.02
    assert p.var() / (share * (1 - share) / O.SAMPLES) < 1.2


def test_likeness_follows_edits_and_order(spark):
    r = random.Random(3)
    word = [f"w{k}" for k in range(300)]
    edited = list(word)
    for k in r.sample(range(300), 6):
        edited[k] = "zz"
    moved = word[150:] + word[:150]
    texts = [" ".join(x) for x in (word, edited, moved, [f"v{k}" for k in range(300)], word[:2], [])]
    f = [points(t) for t in texts]
    row = spark.range(1).select(*[O.likeness(f[0], x).alias(f"c{k}") for k, x in enumerate(f)], O.likeness(f[5], points(" \n")).alias("none"), O.likeness(f[4], f[4]).alias("short")).first()
    same, near, turned, other, short, empty, none, two = row
    assert (same, other, short, empty, none, two) == (1.0, 0.0, 0.0, 0.0, 1.0, 1.0)
    assert 0.6 < near < 1 and 0.5 < turned < 1


def test_query_against_direct_pairs(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    order = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in O.op3_order_minhash(spark, SF).collect()}
    assert got.keys() == text.keys()
    for k, i in enumerate(order):
        after = text[order[(k + 1) % len(order)]]
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + after[:half]
        assert got[i]["n_chars"] == len(text[i])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    prints = {}
    for i, r in got.items():
        prints.setdefault(text[i], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > np.mean([r["near_next"] for r in got.values()])


def test_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 3)
    rows = [(k * 7 % 101, f"t{k}") for k in range(101)] + [(None, "null")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["next_v"] for r in O.beside_next(d, {"v": F.col("text")}).collect()}
    order = sorted((x for x in rows if x[0] is not None), reverse=True) + [(None, "null")]
    assert got == {order[k][0]: order[(k + 1) % len(order)][1] for k in range(len(order))}


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a", "x"), (3, "a", "x"), (None, "b " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    got = O.fingerprints(docs).collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 0, 1, 1, 40_000]
    one = O.fingerprints(docs.where("doc_id = 2")).first()
    assert (one["near_edited"], one["near_next"], one["fingerprint"]) == (1.0, 1.0, "")
    assert O.fingerprints(docs.limit(0)).collect() == []


# Quality


def test_marginals_by_enumeration():
    import itertools

    r = np.random.default_rng(0)
    pairs = r.normal(size=(2, 2))
    sizes = [1, 3, 5]
    score = r.normal(size=sum(sizes))
    ends = np.cumsum(sizes)
    good = Q.Field(np.zeros(1), pairs, 0.0, 1.0).marginals(score, ends)
    at = 0
    for n in sizes:
        total, each = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(pairs[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            each += w * np.array(y)
        assert np.allclose(good[at : at + n], each / total)
        at += n


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op2_quality_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len(held) > 80 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "\n\n", "x"), (3, "a " * 100_000, "x"), (3, "b\n" * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 7), (None, 1), (3, None)], "doc_id bigint, quality int")
    field = Q.train(docs, labels)
    got = Q.score_quality(docs, field).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert Q.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in Q.score_quality(docs, None).collect()} == {0.5}
    assert Q.score_quality(docs.limit(0), field).collect() == []


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mixture", "byte_bpe"]
    for name, f in P.STAGES:
        before = docs
        docs = P.stage(f(spark, before, SF), f"test_{name}")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "near_dedup":
            want = {r["doc_id"] for r in N.near_duplicates(before).where("kept").collect()}
            assert now == want and docs.count() == len(want)
        ids = now
    assert {r[0] for r in docs.select("round_trip").collect()} == {True}


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as P

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = " ".join(f"word{k} and" for k in range(40)) + "."
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, f in P.STAGES:
            docs = P.stage(f(spark, docs, SF), f"odd_{name}")
        assert docs.count() <= len(rows) * 3


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline as P

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " more"), (4, a), (5, b), (5, b + " more"), (2, c), (7, c), (7, a + " end"), (None, c), (None, ""), (None, ""), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    got = [(r["doc_id"], r["text"]) for r in P.near(spark, docs, SF).collect()]
    assert sorted(((i, t[0]) for i, t in got if t), key=repr) == [(2, "c"), (4, "a"), (5, "b")]
    assert sorted(((i, t) for i, t in got if not t), key=repr) == [(8, None), (None, "")]


def test_fitting_reads_lines_past_the_first(spark, monkeypatch):
    """Every line of the sampled documents, described as in scoring, and whole documents within the bound."""
    fitted = []
    monkeypatch.setattr(Q, "fit", fitted.append)
    texts = {1: "\n".join([f"A clean line of words {k}." for k in range(300)] + ["junk | junk !!"] * 150), 2: "one\ntwo"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")
    Q.train(docs, labels)
    for label, i in ((0, 1), (1, 2)):
        pieces = [x for x, y in fitted[0] if y == label]
        assert max(map(len, pieces)) <= Q.FIT_LINES
        assert np.array_equal(np.concatenate(pieces), Q.line_features(texts[i])[0])
    monkeypatch.setattr(Q, "FIT_DOCS", 2)
    monkeypatch.setattr(Q, "FIT_LINES", 100)
    Q.train(docs, labels)
    assert [y for _, y in fitted[1]] == [1]

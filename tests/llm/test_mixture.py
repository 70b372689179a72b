import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlweave.llm import common
from urlweave.llm import mixture as M

SF = "/root/testdata/sf0.01"


def targets(sizes):
    """Share again and again until no source is above three times its size. sizes: [(source, size)] in order."""
    weight = {s: k % 3 + 1 for k, (s, _) in enumerate(sizes)}
    size, capped = dict(sizes), set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in size if s not in capped)
        share = {s: 3 * size[s] if s in capped else left * weight[s] / total for s in size}
        over = {s for s in size if s not in capped and share[s] > 3 * size[s]}
        if not over:
            return share
        capped |= over


@pytest.mark.parametrize("sizes", [[("a", 100), ("b", 5), ("c", 1), (None, 40)], [("a", 0), ("b", 10)], [("a", 7)], [("a", 1), ("b", 1), ("c", 1000)], [("a", 0), (None, 0)], [("a", 3), ("b", 2), ("c", 2), ("d", 900), ("e", 5)]])
def test_targets(spark, sizes):
    d = spark.createDataFrame(sizes, "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in M.source_targets(d).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert abs(got[s] - t) < 1e-6 * max(1, t)


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = sorted(r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("bigint"), 5, 0)).collect())
        assert got == list(range(n))


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = M.op7_mixture(spark, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    assert {r["doc_id"]: r["size"] for r in got} == size
    per_source, taken = {}, {}
    for i, r in docs.items():
        per_source[r["source"]] = per_source.get(r["source"], 0) + size[i]
    want = targets(sorted(per_source.items()))
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == per_source[s] and abs(r["target"] - want[s]) < 1e-6 * want[s]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * M.BLOCK_WORDS, s
    again = M.op7_mixture(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_taken_by_brute_force_from_the_draws(spark, monkeypatch):
    """Draws scatter as a multinomial; numbered, corrected, permuted and joined by hand they give the words taken."""
    monkeypatch.setattr(M, "SHARD_SLOTS", 64)
    monkeypatch.setattr(M, "RUN", 4)
    mix = M.Mix(spark.read.parquet(f"{SF}/documents.parquet"))
    sources = {r["source_at"]: r for r in mix.sources.collect()}
    slots = {a: r["slots"] for a, r in sources.items()}
    counts = {(r["shard"], r["source_at"]): r["drawn"] for r in mix.counts.collect()}
    shards = sorted({s for s, _ in counts})
    table = np.array([[counts.get((s, a), 0) for a in slots] for s in shards])
    assert table.sum() == sum(slots.values()) and (table.sum(axis=1)[:-1] == 64).all()
    share = np.array(list(slots.values())) / table.sum()
    assert 0.7 < (table[:-1].var(axis=0) / (64 * share * (1 - share))).mean() < 1.3

    places, spare = [], []  # (shard, source, j) that stay; shards of slots drawn beyond the target, in order
    drawn = dict.fromkeys(slots, 0)
    for a in sorted(slots):
        for s in shards:
            for _ in range(counts.get((s, a), 0)):
                if drawn[a] < slots[a]:
                    places.append((s, a, drawn[a]))
                else:
                    spare.append(s)
                drawn[a] += 1
    assert 0 < len(spare) < 0.1 * table.sum()
    handed = iter(spare)
    for a in sorted(slots):
        places += [(next(handed), a, j) for j in range(drawn[a], slots[a])]
    key = spark.createDataFrame([(a, j, j // sources[a]["blocks"], j % sources[a]["blocks"], sources[a]["blocks"]) for _, a, j in places], "a bigint, j bigint, epoch bigint, x bigint, blocks bigint")
    block = {(r["a"], r["j"]): r["b"] for r in key.select("a", "j", M.permuted(F.col("x"), F.col("blocks"), mix.seed, F.col("a"), F.col("epoch")).alias("b")).collect()}
    want = sorted((s, a, j // sources[a]["blocks"], block[a, j]) for s, a, j in places)
    assert sorted((r["shard"], r["source_at"], r["epoch"], r["block"]) for r in mix.slots().collect()) == want
    held = {}
    for r in mix.segments().collect():
        held.setdefault((r["source_at"], r["block"]), []).append((r["rid"], r["words"]))
    taken = {}
    for _, a, _, b in want:
        for rid, words in held[a, b]:
            taken[rid] = taken.get(rid, 0) + words
    assert {r["rid"]: r["taken"] for r in mix.taken().collect()} == taken


def test_located(spark):
    ranges = [(0, 5, "a"), (5, 5, "none"), (5, 300, "b"), (300, 301, "c"), (301, 40_000, "d")]
    points = [0, 4, 5, 63, 64, 299, 300, 301, 39_999]
    got = M.located(spark.createDataFrame([(x,) for x in points], "x bigint"), "x", spark.createDataFrame(ranges, "low bigint, high bigint, name string")).collect()
    assert sorted((r["x"], r["name"]) for r in got) == [(x, next(n for low, high, n in ranges if low <= x < high)) for x in points]


def test_documents_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    taken = {r["doc_id"]: r["taken"] for r in M.Mix(docs).by_row().collect()}
    got = M.mix_documents(docs)
    assert got.columns == docs.columns
    words = {r["doc_id"]: r["w"] for r in got.groupBy("doc_id").agg(F.sum(M.words_in(F.col("text"))).alias("w")).collect()}
    assert words == {i: t for i, t in taken.items() if t}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == text[r["doc_id"]] or set(r["text"].split()) <= set(text[r["doc_id"]].split())


def test_odd_rows(spark):
    rows = [(1, None, "a", 3), (2, "", "a", 3), (3, "x y z", None, 3), (3, "x y z", None, 3), (None, "u v", "b", 3), (5, "w " * 50_000, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = sorted((r["doc_id"] or 0, r["size"], r["source_size"], r["taken"] <= 3 * r["size"]) for r in M.Mix(docs).by_row().collect())
    assert got == [(0, 2, 50_002, True), (1, 0, 0, True), (2, 0, 0, True), (3, 3, 6, True), (3, 3, 6, True), (5, 50_000, 50_002, True)]
    assert M.Mix(docs.limit(0)).by_row().collect() == []
    assert M.mix_documents(docs.limit(0)).collect() == []


def test_clashing_names(spark):
    names = ["_mix_row", "_MIX_PARTS", "_mix_copy", "rid", "shard", "a.b", "c`d"]
    docs = spark.createDataFrame([(1, "x y", "s", *range(7)), (2, "z", None, *range(7))], ", ".join(["doc_id bigint", "text string", "source string", *(f"`{n.replace('`', '``')}` int" for n in names)]))
    got = M.mix_documents(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()} and got.count()


def test_texts_are_cut_by_a_small_plan(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "a b c " * (k + 1)) for k in range(20)], "doc_id bigint, source string, text string")
    plan = M.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= 4


def test_staging_relieves_a_full_driver(spark, monkeypatch):
    def collections():
        return sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    monkeypatch.setattr(common, "HEAP_SHARE", 0)
    before = collections()
    assert common.stage(spark.range(3), "three").count() == 3
    assert collections() > before
    monkeypatch.setattr(common, "HEAP_SHARE", 1)
    before = collections()
    assert common.stage(spark.range(3), "three").count() == 3
    assert collections() == before

"""Against all pairs, by sets of words."""

import random
import re

import numpy as np
import pytest

from urlweave.llm import near_dedup as N


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets))


def family(r, n_docs):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    bases = [[word() for _ in range(r.randint(1, 150))] for _ in range(max(2, n_docs // 12))]
    rows = []
    for i in range(n_docs):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w = w[: max(1, int(len(w) * r.choice([0.7, 0.8, 0.9])))]
        rows.append((i * 3 + 1, r.choice([" ", "\n", " \t"]).join(w).replace("a", r.choice(["a", "A"]))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = family(random.Random(seed), 240)
    rows += [(100_000, None), (100_001, ""), (100_002, " \n\t"), (100_003, "one"), (100_004, "ONE"), (100_005, "a b c d"), (100_006, "a b c d"), (100_007, "a b c d e")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, n string, digest int")
    got = sorted(tuple(r) for r in N.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_family_whose_edits_collide(spark, monkeypatch):
    """Copies of one text with few alternatives for each edit: links between copies that are too far from the text itself."""
    monkeypatch.setattr(N, "RARE", 3)
    monkeypatch.setattr(N, "PIVOTS", 1)
    r = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in r.sample(range(0, 100, 4), r.choice([1, 2, 3, 4, 5])):
            w[k] = r.choice(["x", "y"])
        rows.append((i + 1, " ".join(w)))
    got = sorted(tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = brute(rows)
    assert got == want and len({x[2] for x in want}) > 3


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "x y z"), (None, "a b c d e f"), (None, None), (2, "w " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r[0] or 0, r[1], r[2] or 0, r[3]) for r in N.near_duplicates(docs).collect()))
    assert got == [(0, 0, 0, True), (0, 2, 5, False), (2, 1, 2, True), (5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True)]
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_sketch_estimates_similarity():
    """Bits that differ grow with dissimilarity; a pair at the threshold stays far under the filter."""
    r = np.random.default_rng(3)
    sampler = N.Sampler()
    seen = {}
    for share in (0.5, 0.75, 0.9):
        bits = []
        for _ in range(60):
            x = r.integers(0, 2**63, 800, dtype=np.uint64)
            both = int(800 * 2 * share / (1 + share))
            a, b = x[:800], np.concatenate([x[:both], r.integers(0, 2**63, 800 - both, dtype=np.uint64)])
            bits.append(sum(int(v).bit_count() for v in (sampler.sketch(sampler.samples(a)) ^ sampler.sketch(sampler.samples(b))).view(np.uint64)))
        seen[share] = np.mean(bits)
        if share >= 0.75:
            assert max(bits) <= N.SKETCH_DIFFER
    assert seen[0.9] < seen[0.75] < seen[0.5]
    assert abs(seen[0.75] - N.SKETCH_BITS / 2 * (1 - np.exp(-N.SAMPLES / N.SKETCH_BITS))) < 12


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 200, 1) if k % 50 != 49]
    random.Random(0).shuffle(edges)
    got = {tuple(r) for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(k, k // 50 * 50) for k in range(200)}


def test_few_edges_cost_few_jobs(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(1 << 60, (1 << 60) + 1)], "a bigint, b bigint").where("a <> b")
    spark.sparkContext.setJobGroup("few_edges", "")
    local = sorted(tuple(x) for x in N.components(edges).collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few_edges")) <= 5
    monkeypatch.setattr(N, "LOCAL_EDGES", 0)
    assert sorted(tuple(x) for x in N.components(edges).collect()) == local

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlweave.llm import maxent_lm as M

SF = "/root/testdata/sf0.001"


def tokens(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    return [*out, " "]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(docs):
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t in docs}


def test_counts_base_and_gain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = base(docs)
    got = M.op10_maxent_lm(spark, SF).collect()
    assert len(got) == len(docs)
    gain = 0.0
    for r in got:
        n_tokens, n_known, n, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n_tokens, n_known, n, held(r["doc_id"]))
        assert math.isclose(r["base_score"], score, rel_tol=1e-9)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


def by_hand(docs, top):
    """The score of every text: counts, features, gradients and softmaxes one token and one outcome at a time."""
    head = {w: k for k, (w, _) in enumerate(top[: M.HEAD])}
    counts = Counter(w for _, text, held_out in docs if not held_out for w in M.tokens_of(text))
    cls = lambda w: head.get(w, int(M.class_number(int.from_bytes(w[-3:], "big"))))
    bucket = lambda w: int(M.bucket_number(int.from_bytes(w[:3], "big"), len(w)))
    slots = M.word_slots(sum(counts.values()))

    def events(text):
        """(level, context, outcome, features) for each choice of each token."""
        words = M.tokens_of(text)
        hashed = [int(x) for x in M.hashes(words)]
        c = [cls(w) for w in words]
        for k, w in enumerate(words):
            back = lambda x, n: x[k - n] if k >= n else 0  # noqa: E731, B023
            word = (back(hashed, 1) * 0xD6E8FEB86659FD93 % 2**64) >> 40
            far = [(n, back(c, n) * M.CLASSES + back(c, n + 1)) for n in (1, 3, 5)] + [("w", word % slots)]
            group = c[k] // M.WIDTH
            yield w, 0, 0, group, far
            yield w, 1, group, c[k] % M.WIDTH, far
            if c[k] >= M.HEAD:
                yield w, 2, c[k], bucket(w), [("w", word % M.NEAR), ("c", back(c, 2))]

    sizes, kinds = (M.GROUPS, M.WIDTH, M.BUCKETS), (4, 4, 2)
    train = [e for _, text, held_out in docs if not held_out for e in events(text)]
    seen, hoped = {}, {}
    for _, level, context, outcome, f in train:
        for x in [*f, "bias"]:
            seen.setdefault((level, context, x), [0] * sizes[level])[outcome] += 1

    def bias(level, context):
        held = [n + 0.5 for n in seen.get((level, context, "bias"), [0] * sizes[level])]
        return [n / sum(held) for n in held]

    weights = {}

    def weight(level, context, x):
        if (found := weights.get((level, context, x))) is None:
            share = bias(level, context)
            held = seen.get((level, context, x), [0] * sizes[level])
            found = [math.log(q) for q in share] if x == "bias" else [M.START * math.log((n + M.SMOOTH * q) / (sum(held) + M.SMOOTH) / q) for n, q in zip(held, share, strict=True)]
            weights[level, context, x] = found
        return found

    def probabilities(level, context, f):
        z = [sum(t) for t in zip(*(weight(level, context, x) for x in [*f, "bias"]), strict=True)]
        return [math.exp(v) / sum(map(math.exp, z)) for v in z]

    for _ in range(M.PASSES):
        hoped.clear()
        for _, level, context, _, f in train:
            p = probabilities(level, context, f)
            for x in [*f, "bias"]:
                at = hoped.setdefault((level, context, x), [0] * sizes[level])
                hoped[level, context, x] = [u + v for u, v in zip(at, p, strict=True)]
        for key, h in hoped.items():
            own, rough = weight(*key), [(n - e) / (e + M.SMOOTH) for n, e in zip(seen[key], h, strict=True)]
            steps = [max(-0.5, min(0.5, r)) / 4 for r in rough] if key[2] == "bias" else [max(-1.5, min(1.5, r)) / kinds[key[0]] for r in rough]
            weights[key] = [u + v for u, v in zip(own, steps, strict=True)]
    room = Counter()
    place = lambda w: (cls(w), bucket(w) if cls(w) >= M.HEAD else 0)
    for w, n in counts.items():
        room[place(w)] += n + 1
    out = []
    for _, text, _ in docs:
        score = sum(math.log10((counts[w] + 1) / (room[place(w)] + 1)) for w in M.tokens_of(text))
        out.append(score + sum(math.log10(probabilities(level, context, f)[outcome]) for _, level, context, outcome, f in events(text)))
    return out


@pytest.mark.parametrize("lexicon", [65_536, 5])
def test_score_by_hand(spark, monkeypatch, lexicon):
    monkeypatch.setattr(M, "LEXICON", lexicon)
    monkeypatch.setattr(M, "FAN_IN", 2)
    r = __import__("random").Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(40)]
    docs = [(k, " ".join(r.choice(words[: r.choice([3, 12, 40])]) for _ in range(r.randint(0, 40))), k % 7 == 2) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, held_out boolean").repartition(5)
    got = {x["doc_id"]: x["score"] for x in M.score_documents(frame).collect()}
    counts = Counter(w for _, text, held_out in docs if not held_out for w in M.tokens_of(text))
    want = by_hand(docs, sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    for (k, _, _), score in zip(docs, want, strict=True):
        assert math.isclose(got[k], score, rel_tol=1e-3, abs_tol=1e-3)


def test_outcomes_sum_to_one():
    r = np.random.default_rng(0)
    model = M.Trained([(b"the", 3)], np.zeros((M.CLASSES, M.BUCKETS)), M.KIND)
    for level in model.levels:
        level.weights = r.normal(size=level.weights.shape)
        level.lay()
        rows = r.integers(0, level.rows, (level.kinds + 1, 9))
        assert np.allclose(level.probabilities(rows).sum(axis=0), 1)
        every = [level.log_probability(rows, np.full(9, k)) for k in range(level.width)]
        assert np.allclose(np.exp(every).sum(axis=0), 1)


def test_lexicon_holds_whole_counts(spark, monkeypatch):
    monkeypatch.setattr(M, "LEXICON", 50)
    rows = [(f"w{k}".encode(), 1 + 3000 // (k + 1)) for k in range(2000)]
    found = M.most_frequent(spark.createDataFrame(rows, "word binary, n bigint"))
    assert M.HEAD <= len(found) <= 50 and found == sorted(rows, key=lambda x: (-x[1], x[0]))[: len(found)]
    flat = M.most_frequent(spark.createDataFrame([(w, 7) for w, _ in rows], "word binary, n bigint"))
    assert len(flat) == M.HEAD


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b c", 5), (3, "Word " * 3000, 5), (4, " \t\n", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").withColumn("held_out", F.lit(False))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in M.score_documents(docs.select("doc_id", "text", "held_out")).collect())
    assert got == [(0, 4, 4), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 3001, 3001), (4, 1, 1)]


def test_empty_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, held_out boolean")
    assert M.score_documents(docs).collect() == []
    one = spark.createDataFrame([(1, "a b", True)], "doc_id bigint, text string, held_out boolean")
    (r,) = M.score_documents(one).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)
    assert math.isfinite(r["score"])


def test_tokens_and_classes_as_arrays(spark):
    texts = ["The cat  sat\n", "", None, "\x00 a\x0bB\u00a0c ab", "x" * 3000 + " the cat", " "]
    got = M.Tokens(texts)
    want = [w for t in texts for w in M.tokens_of(t)]
    assert [got.word(k) for k in range(len(got.hash))] == want
    assert got.starts.tolist() == [0, 4, 5, 6, 11, 15]
    assert len(set(got.hash.tolist())) == len(set(want))
    assert M.hashes(want).tolist() == got.hash.tolist()
    d = spark.createDataFrame([(bytearray(w),) for w in want], "word binary")
    assert [r[0] for r in d.select(M.class_column(F.col("word"))).collect()] == got.cls.tolist()
    assert [r[0] for r in d.select(M.bucket_column(F.col("word"))).collect()] == got.bucket.tolist()


def test_capacity_by_held_out_gain(spark):
    """Without the softmax inside classes, the 64 classes in one softmax gained 7,807 here."""
    r = M.op10_maxent_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum(F.col("score") - F.col("base_score")).alias("gain")).first()
    assert r["gain"] > 7807


def test_slots_grow_with_tokens():
    found = [M.word_slots(n) for n in (0, 10**6, 10**7, 10**8, 10**12)]
    assert found == sorted(found) and found[0] == M.KIND >= M.CLASSES**2 and found[-1] == M.MOST_SLOTS > M.KIND
    h, c = np.arange(1, 50, dtype=np.uint64) * np.uint64(M._BASE), np.full(49, M.CLASSES - 1)
    f, near = M.features(h, c, np.array([0, 20]), M.MOST_SLOTS)
    low = M.KIND * (M.KINDS - 1)
    assert f[-1].min() >= low and low + M.KIND <= f[-1].max() < low + M.MOST_SLOTS
    assert near[0].max() < M.NEAR <= near[1].min() and near.max() < M.NEAR + M.CLASSES

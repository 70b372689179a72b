"""Against a direct reading of the rules, on small documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from urlweave.llm import line_dedup as L

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """The lines with words of each document: (text, words, place)."""

    lines = {i: [(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x), len(WORDS.findall(x)), k) for k, x in enumerate(t.split("\n")) if WORDS.search(x)] for i, t in docs}
    return lines


def windows(lines):
    """(gram start, gram lines) candidates of every window of RUN_WORDS words."""
    out = []
    for a in range(len(lines)):
        total, b = 0, a
        while b < len(lines) and total < L.RUN_WORDS:
            total += lines[b][1]
            b += 1
        if total < L.RUN_WORDS:
            continue
        grams = []
        for s in range(a, b):
            n, e = 0, s
            while e < b and n < L.GRAM_WORDS:
                n += lines[e][1]
                e += 1
            if n >= L.GRAM_WORDS:
                grams.append((s, tuple(x[0] for x in lines[s:e])))
        out.append((a, b, grams))
    return out


def made(r, n):
    line = lambda k: " ".join("".join(r.choice("abcd") for _ in range(4)) for _ in range(k))
    shared = [[line(r.choice([3, 8, 20, 55])) for _ in range(r.randint(1, 5))] for _ in range(4)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts += r.choice(shared) if r.random() < 0.6 else [line(r.choice([1, 6, 30])) for _ in range(r.randint(1, 3))]
            if r.random() < 0.3:
                parts.append("")
        docs.append((i, "\n".join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_promises(spark, seed):
    """Deleted lines have an equal earlier line; no run of RUN_WORDS words that an earlier place has is left whole."""
    docs = made(random.Random(seed), 60)
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    lines = brute(docs)
    seen_lines, seen_runs, gone_any = set(), set(), 0
    for i, text in docs:
        kept = (got[i]["text"] or "").split("\n") if got[i]["text"] else []
        whole = text.split("\n")
        # what is kept is a subsequence of the lines
        at, dropped = 0, []
        for k, x in enumerate(whole):
            if at < len(kept) and kept[at] == x and len(kept) - at <= len(whole) - k:
                at += 1
            else:
                dropped.append(x)
        assert at == len(kept) or not kept
        assert len(whole) - got[i]["n_removed"] == (len(kept) if got[i]["text"] else len(whole) - got[i]["n_removed"])
        gone_any += got[i]["n_removed"]
        for x in dropped:
            if WORDS.search(x):
                assert x.strip(" ") in seen_lines or whole.count(x) > 1
        own = lines[i]
        for a, b, _ in windows(own):
            run = tuple(x[0] for x in own[a:b])
            if run in seen_runs:  # an earlier place has the whole window: it can't be left whole
                assert "\n".join(run) not in "\n".join(y.strip(" ") for y in kept if WORDS.search(y)) or whole.count(own[a][0]) > 1
        for a, b, _ in windows(own):
            seen_runs.add(tuple(x[0] for x in own[a:b]))
        seen_lines |= {x[0] for x in own}
    assert gone_any > 20


def test_passages_of_one_and_more_lines(spark):
    long = " ".join(f"w{k}" for k in range(60))
    three = [" ".join(f"{c}{k}" for k in range(20)) for c in "xyz"]
    docs = [(1, f"first line\n{long}\nlast"), (2, f"{long}\nsecond document"), (3, "\n".join(["a b c", *three, "d e f"])), (4, "\n".join(["g h i", *three, "j k l"])), (5, "first line\nsecond document"), (6, long)]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: docs[0][1], 2: "second document", 3: docs[2][1], 4: "g h i\nj k l", 5: docs[4][1], 6: ""}


def test_repeats_inside_a_document(spark):
    line = " ".join(f"w{k}" for k in range(30))
    (r,) = L.dedup_lines(spark.createDataFrame([(1, "\n".join([line] * 5 + ["end"]))], "doc_id bigint, text string")).collect()
    assert (r["text"], r["n_removed"]) == (f"{line}\nend", 4)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long, "a", 5), (1, long, "b", 5), (1, long, "b", 5), (2, None, "c", 5), (3, "", "c", 5), (4, "\n\n", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string, n_chars bigint")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"], r["n_chars"]) for r in L.dedup_lines(docs).collect()), key=repr)
    assert got == sorted([(0, long, 0, 5), (1, "", 1, 0), (1, "", 1, 0), (2, None, 0, 5), (3, "", 0, 5), (4, "\n\n", 0, 5)], key=repr)
    assert L.dedup_lines(docs.limit(0)).collect() == []


def test_window_after_a_frequent_line(spark):
    """The frequent line's first place is followed by other lines; later places share the whole window all the same."""
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    docs, passages = [], []
    for p in range(20):
        run = [line("licence", 30), line(f"x{p}_", 15), line(f"y{p}_", 15)]
        run = run[p % 3 :] + run[: p % 3]
        passages.append(run)
        docs += [(100 + 3 * p + k, "\n".join([f"head {p} {k}", *run, f"tail {p} {k}"])) for k in range(3)]
    docs.append((1, "\n".join(["start", line("licence", 30), "other end", line("z", 40)])))
    got = {r["doc_id"]: (r["text"] or "").split("\n") for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for p, run in enumerate(passages):
        for k in (1, 2):
            assert got[100 + 3 * p + k] == [f"head {p} {k}", f"tail {p} {k}"]
        assert set(run[j] for j in range(3) if "licence" not in run[j]) <= set(got[100 + 3 * p])
    assert got[1] == docs[-1][1].split("\n")


def test_a_long_text_of_equal_lines(spark):
    """Lines that repeat with a period, ten thousands of them, in two documents."""
    line = lambda c: " ".join(f"{c}{k}" for k in range(30))
    docs = [(1, "\n".join([line("a")] * 20_000)), (2, "\n".join([line("a")] * 20_000 + ["end"])), (3, "\n".join([line("b"), line("c"), "short"] * 5000))]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1] == (line("a"), 19_999) and got[2] == ("end", 20_000)
    assert got[3][0].split("\n")[:3] == [line("b"), line("c"), "short"] and line("b") not in got[3][0].split("\n")[3:] and line("c") not in got[3][0].split("\n")[3:]


def test_clashing_names(spark):
    names = ["_gone_id", "_GONE", "_text_hash", "_gone_hash", "gram", "n_lines", "a.b", "c`d"]
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, long, *range(8)), (2, f"{long}\nend", *range(8))], ", ".join(["doc_id bigint", "text string", *(f"`{n.replace('`', '``')}` int" for n in names)]))
    got = L.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert [(r["text"], r["_GONE"], r["n_removed"]) for r in got.orderBy("doc_id").collect()] == [(long, 1, 0), ("end", 1, 1)]


def test_passages_inside_lines(spark):
    """A passage of 60 words inside long lines goes but for the pieces up to its first and from its last cut; all else stays."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(4))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(10) for _ in range(6))
    docs = [(k, "\n".join([sentence(9), " ".join([sentence(40)[:-1], passage, *(sentence(12) for _ in range(3))]), "", sentence(5)])) for k in range(4)]
    docs += [(9, " ".join(sentence(12) for _ in range(30)))]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[0] == (docs[0][1], 0) and got[9] == (docs[4][1], 0)
    for k in (1, 2, 3):
        text, n = got[k]
        inner = " ".join(passage.split(" ")[10:]) + " "  # the first sentence is cut with what stands before it
        assert n == 5 and text == docs[k][1].replace(inner, "")


def test_units_are_the_line(spark):
    r = random.Random(1)
    lines = ["".join(r.choice("abN. !?\t") for _ in range(r.choice([0, 5, 300]))) for _ in range(200)]
    d = spark.createDataFrame([(x,) for x in lines], "x string").select("x", L.units_of(F.col("x")).alias("u"))
    assert all("".join(r["u"]) == r["x"] for r in d.collect())
    text = "\n".join(lines)
    (got,) = spark.createDataFrame([(text,)], "x string").select(L.without(F.split("x", "\n"), F.array().cast("array<bigint>"))).first()
    assert got == text


def test_short_runs_stay(spark):
    """Runs under RUN_WORDS words stay, whatever their grams."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(4))
    lines = [" ".join(word() for _ in range(n)) for n in (13, 20, 24)]
    docs = [(k, "\n".join([" ".join(word() for _ in range(40)), lines[k % 3], " ".join(word() for _ in range(40))])) for k in range(30)]
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(x["doc_id"], x["text"]) for x in got} == set(docs)


def test_texts_are_cut_once_and_shuffled_whole(spark, monkeypatch):
    """The line table cuts each text once; fingerprints are made of documents dealt out before they fall into rows."""
    plans = {}

    def stage(df, tag, real=L.stage):
        plans[tag] = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag)

    monkeypatch.setattr(L, "stage", stage)
    line = lambda c: " ".join(f"{c}{k}" for k in range(30))
    docs = [(1, line("a")), (2, f"{line('b')}\n{line('a')}"), (3, " \n")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: line("a"), 2: line("b"), 3: " \n"}
    assert plans["lines"][0].count(L.CUT) == 1
    rows, _, whole = plans["grams"][1].partition("posexplode")
    assert "Exchange" in whole and "Exchange" not in rows


def test_fingerprints_are_told_once(spark):
    """One row for each fingerprint and place, with the last place before it, though many windows select one gram."""
    r = random.Random(4)
    line = lambda n: " ".join("".join(r.choice("ab") for _ in range(3)) for _ in range(n))
    own = [line(n) for n in (1, 2, 3, 13, 26)]
    docs = spark.createDataFrame([(k, "\n".join(r.choice(own) for _ in range(80))) for k in range(5)], "doc_id bigint, text string")
    rows = [tuple(x) for x in L.selected_grams(L.line_table(docs)).select("doc_id", "gram", "at", "before").collect()]
    assert len({x[:3] for x in rows}) == len(rows) > 400
    last = {}
    for i, gram, at, before in sorted(rows, key=lambda x: x[:3]):
        assert before == last.get((i, gram))
        last[i, gram] = at

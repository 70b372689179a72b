import hashlib
import random
import struct

import numpy as np
import pytest
import tiktoken

from urlweave.llm import bpe as B

SF = "/root/testdata/sf0.001"
PATH, PATTERN = B.default_vocabulary()


@pytest.fixture(scope="module")
def tokens():
    return B.read_ranks(PATH)


@pytest.fixture(scope="module")
def own(tokens):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def odd_texts(n):
    r = random.Random(5)
    letters = "abcetnT'  \n\t\r .,!0123éüñß漢字кирил😀\x1c\x85şĀ"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_the_space_led_shortcut_is_for_this_pattern():
    assert PATTERN == B.SPACE_LED


def test_like_tiktoken(tokens, own):
    encoder = B.Encoder(tokens, PATTERN)
    texts = [*odd_texts(3000), "", " ", "  a", "a  b ", "\n \nb", "don't we'll", "x" * 5000, "éa" * 3000, "<|endoftext|>"]
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), "<u4")
        assert ids.tolist() == own.encode_ordinary(t), t
        assert B.decode_text(B.decode_chunks(ids, tokens, 3)) == t


def test_pairs_agree_with_the_definition(tokens):
    machine, r = B.Transducer(tokens), random.Random(2)
    for _ in range(4000):
        a, b = r.randrange(len(tokens)), r.randrange(len(tokens))
        assert machine.own(a) == (machine.merged(tokens[a]) == [a])
        if machine.own(a) and machine.own(b):
            assert machine.pair(a, b) == (machine.merged(tokens[a] + tokens[b]) == [a, b])


def test_emission_waits_for_certainty_and_is_bounded(tokens):
    machine = B.Transducer(tokens)
    piece = ("abcdefgh" * 400).encode()
    parts = list(machine.emit(piece))
    assert len(parts) > 2 and [t for p in parts for t in p] == machine.encode(piece)


def test_forgetting_changes_nothing(tokens, own, monkeypatch):
    monkeypatch.setattr(B, "MAX_MOVES", 50)
    monkeypatch.setattr(B, "MEMO_BYTES", 1000)
    encoder = B.Encoder(tokens, PATTERN)
    for t in [*odd_texts(200), "".join(chr(97 + k * k % 26) for k in range(3000)), "ab" * 2000]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == own.encode_ordinary(t)


def test_utf8_stream_like_python():
    r = random.Random(1)
    for _ in range(4000):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xE0, 0xF4, 0x90]) for _ in range(r.randint(0, 12)))
        stream, step = B.Utf8Stream(), r.randint(1, 3)
        parts = [stream.feed(data[k : k + step]) for k in range(0, len(data), step)]
        assert "".join([*parts, stream.end()]) == data.decode("utf-8", "replace")


def test_query_and_round_trip(spark, own):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = B.op1_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_tokenise_in_small_batches(spark, own, monkeypatch):
    monkeypatch.setattr(B, "BATCH_BYTES", 50)
    rows = [(k, t, f"s{k}") for k, t in enumerate([None, "", "abc " * 100, *odd_texts(60)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `so``ur.ce` string")
    got = B.tokenise(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "so`ur.ce", "ids", "n_tokens", "round_trip"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert all(found[k]["ids"] == own.encode_ordinary(t or "") and found[k]["round_trip"] and found[k]["n_tokens"] == len(found[k]["ids"]) for k, t, _ in rows)
    assert B.tokenise(docs.limit(0), PATH, PATTERN).collect() == []


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "abc", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = B.decode(B.encode(docs, PATH, PATTERN), PATH)
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0, r["decoded"]) for r in got.collect()) == [(0, True, "abc"), (1, False, ""), (2, False, ""), (2, False, "")]
    assert B.encode(docs.limit(0), PATH, PATTERN).collect() == []


def test_frequent_words_outlast_rare_ones(monkeypatch):
    monkeypatch.setattr(B, "MEMO_BYTES", 60_000)
    path, pattern = B.default_vocabulary()
    encoder = B.Encoder(B.read_ranks(path), pattern)
    made = []
    by_machine = encoder.machine.encode
    monkeypatch.setattr(encoder.machine, "encode", lambda piece: made.append(piece) or by_machine(piece))
    for k in range(2000):
        encoder.encode(f"the {''.join(chr(97 + int(c)) for c in str(k * 7919))} the")
    assert made.count(b" the") == 1
    held = [*encoder.memo.items(), *encoder.memo.old.items()]
    assert sum(B.getsizeof(k) + B.getsizeof(v) + B.ENTRY_BYTES for k, v in held) <= B.MEMO_BYTES


def test_pairs_and_suffixes_outlast_states(monkeypatch):
    tokens = B.read_ranks(B.default_vocabulary()[0])
    machine = B.Transducer(tokens)
    words = [w.encode() for w in (" photosynthesis", " unbelievable", " straße", " zzqxj", " 12345")]
    first = [machine.encode(w) for w in words]
    looked = []
    pair = machine.pair
    monkeypatch.setattr(machine, "pair", lambda *a: looked.append(a) or pair(*a))
    machine.reset()
    assert [machine.encode(w) for w in words] == first and not looked
    monkeypatch.setattr(B, "MAX_MOVES", 20)
    monkeypatch.setattr(B, "MAX_PAIRS", 5)
    small = B.Transducer(tokens)
    assert [small.encode(w) for w in words] == first
    assert len(small._pair) <= 5 and len(small._followers) <= 20


def test_short_pieces_are_searched_without_states(tokens):
    machine, r = B.Transducer(tokens), random.Random(9)
    pieces = ["".join(r.choice("abeinrstüßé漢😀 %1") for _ in range(r.randint(1, 30))).encode() for _ in range(2000)]
    pieces += [t for t in r.sample(tokens, 2000)] + [r.randbytes(r.randint(1, 12)) for _ in range(1000)]
    assert [machine.encode(p) for p in pieces] == [machine.merged(p) for p in pieces]
    assert len(machine.states) == 1 and not machine.moves


def test_the_search_goes_back():
    tokens = [bytes([k]) for k in range(256)] + [b"bc", b"ab", b"abc", b"cd"]
    machine = B.Transducer(tokens)
    texts = [bytes(r) for n in range(1, 7) for r in np.array(np.meshgrid(*[list(b"abcd")] * n)).reshape(n, -1).T.tolist()]
    assert [machine.encode(t) for t in texts] == [machine.merged(t) for t in texts]

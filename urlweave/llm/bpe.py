"""Byte-level BPE as a lazily determinised finite-state transducer.

Merging by rank has a local description: a token sequence is the encoding of its bytes exactly if each token
encodes to itself and so does each pair of neighbours. Hence the encoding of a prefix ends in one token only,
and after every byte the last token is the suffix token that agrees with the last token before it. The
transducer reads a piece byte by byte. Its state is the longest suffix that a token could still start in, with the
last token at every boundary inside that suffix; each move gives the last token at the new boundary. Tokens are
emitted as soon as the encodings that end at all live boundaries begin with them, which is looked for whenever
a few token lengths are waiting, so that what waits is bounded. Pieces of up to a few token lengths, which are nearly all, need no
states: the same rule finds their tokens by a search that goes on with the longest token and back where none fits. States and moves are made when a text first
needs them (determinised lazily) and are dropped when their number passes a bound; so are the memorised pieces that were not asked for again.

Decoding is a second machine: tokens to bytes, and an incremental UTF-8 automaton that gives out complete
characters and carries the bytes of an open one into the next chunk; bad bytes give U+FFFD as Python's
"replace" does.

``tokenise`` runs both machines in one worker: a text goes in, its ids and whether they decode to it come out.
What a worker holds is bounded in bytes: the memo by MEMO_BYTES, the machine by MAX_MOVES and MAX_PAIRS, a batch that goes out by BATCH_BYTES
or one text.

Defined cases: a null text counts as empty and encodes to no ids; special tokens' strings are ordinary text;
very long texts are encoded whole, piece by piece; rows may repeat; other columns pass through, and existing
columns named like a result column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship, table, with_arrow

#: Moves of the machine at most (some 300 bytes each with their states), and of its live suffixes; beyond, they start anew.
MAX_MOVES = 100_000

#: Bytes of memorised pieces at most; half of them go when it's full.
MEMO_BYTES = 64_000_000

#: Bytes of text that are worked on at once, unless one text has more.
BATCH_BYTES = 2_000_000

#: What a dictionary takes for an entry, beside its key and value, just after it has grown.
ENTRY_BYTES = 100

#: Pieces longer than this many bytes aren't memorised.
LONG_PIECE = 64

#: Bytes by which a search looks up how long the next token can be.
HEAD = 4

#: Remembered pairs of neighbouring tokens at most (some 100 bytes each); beyond, they are looked at anew.
MAX_PAIRS = 300_000


def read_ranks(path: str) -> list[bytes]:
    """A tiktoken rank file as the list of tokens by id."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.tokens = tokens
        #: Bytes that may wait for certainty before it is looked for; shorter pieces are searched.
        self.lookahead = 4 * max(map(len, tokens), default=0)
        #: The length of the longest token that begins with these HEAD bytes.
        self.reach: dict[bytes, int] = {}
        for t in tokens:
            if len(t) > self.reach.get(t[:HEAD], HEAD - 1):
                self.reach[t[:HEAD]] = len(t)
        #: Stands for the token before a piece's first.
        self.start = len(tokens)
        self.prefixes = {t[:k] for t in tokens for k in range(len(t) + 1)}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pair: dict[int, bool] = {}
        self._suffixes = [b""]
        self._suffix_of = {b"": 0}
        self._followers: dict[int, tuple[int, int, list[tuple[int, int]]]] = {}
        self.reset()

    def reset(self, live: tuple[int, tuple[int, ...]] | None = None) -> int:
        """Forget all states but the first and ``live``; the number of ``live``."""
        #: A state is (number of the live suffix, last token at each boundary of it from its start to its end; -1 at the piece's start).
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (-1,))]
        if live is not None and live != self.states[0]:
            self.states.append(live)
        self.state_of = {x: k for k, x in enumerate(self.states)}
        self.moves: dict[int, tuple[int, int]] = {}
        return len(self.states) - 1

    def merged(self, piece: bytes) -> list[int]:
        """By the definition: join the neighbours of least rank, the leftmost first, until none is left. For short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token in its own encoding; None for a single byte, or if it doesn't encode to itself."""
        try:
            return self._halves[token]
        except KeyError:
            pass
        text, found = self.tokens[token], None
        for k in range(1, len(text)):
            left, right = self.rank.get(text[:k], token), self.rank.get(text[k:], token)
            if left < token and right < token and self.own(left) and self.own(right) and self.pair(left, right, token):
                found = (left, right)
                break
        self._halves[token] = found
        return found

    def own(self, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def pair(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether no merge of a rank under ``below`` crosses the border of the two tokens.

        Undoes merges in falling order of rank, those of the right token before equal ones of the left, and
        looks each time whether the two parts at the border would have merged sooner.
        """
        rank, tokens, limit = self.rank, self.tokens, below
        while True:
            joined = rank.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def fits(self, last: int, token: int) -> bool:
        """Whether the token encodes to itself and follows the last one (``start``: any) in an encoding; remembered."""
        if len(self._pair) >= MAX_PAIRS:
            self._pair.clear()
        ok = self._pair[last << 32 | token] = self.own(token) and (last == self.start or self.pair(last, token))
        return ok

    def suffix(self, node: int, byte: int) -> tuple[int, int, list[tuple[int, int]]]:
        """The live suffix that follows another: its number, how many bytes go before it, and the tokens that may end there, longest first, with where they start.

        There are no more suffixes than prefixes of tokens, so their numbers stay when states go.
        """
        if len(self._followers) >= MAX_MOVES:
            self._followers.clear()
        text, drop, get = self._suffixes[node] + bytes([byte]), 0, self.rank.get
        tokens = [(k, t) for k in range(len(text)) if (t := get(text[k:])) is not None and self.own(t)]
        while text[drop:] not in self.prefixes:
            drop += 1
        at = self._suffix_of.setdefault(text[drop:], len(self._suffixes))
        if at == len(self._suffixes):
            self._suffixes.append(text[drop:])
        found = self._followers[node << 8 | byte] = (at, drop, tokens)
        return found

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the last token of the encoding so far; made on first use."""
        node, last = self.states[state]
        node, drop, tokens = self._followers.get(node << 8 | byte) or self.suffix(node, byte)
        pairs = self._pair
        for start, token in tokens:
            if (before := last[start]) < 0:
                break
            if (ok := pairs.get(before << 32 | token)) is None:
                ok = self.fits(before, token)
            if ok:
                break
        else:
            raise ValueError("the ranks lack a single byte")
        new = (node, (*last[drop:], token))
        at = self.state_of.setdefault(new, len(self.states))
        if at == len(self.states):
            self.states.append(new)
        found = self.moves[state << 8 | byte] = (at, token)
        return found

    def path(self, last: list[int], end: int) -> list[int]:
        """The tokens up to a boundary, along the last tokens."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        out.reverse()
        return out

    def emit(self, piece: bytes) -> Iterator[list[int]]:
        """The piece's tokens, as soon as every live boundary's encoding begins with them.

        Looked for when ``lookahead`` more bytes wait than when it was last in doubt, so that the search costs
        a bounded amount a byte. Restarts keep the live state: the machine may be emptied inside a piece.
        """
        state, moves, last, due = 0, self.moves, [-1], self.lookahead
        for byte in piece:
            if (found := moves.get(state << 8 | byte)) is None:
                if len(moves) >= MAX_MOVES:
                    state, moves = self.reset(self.states[state]), self.moves
                found = self.move(state, byte)
            state = found[0]
            last.append(found[1])
            if len(last) > due:
                live = len(self.states[state][1])
                paths = [self.path(last, k) for k in range(len(last) - live, len(last))]
                common = 0
                for column in zip(*paths, strict=False):
                    if len(set(column)) > 1:
                        break
                    common += 1
                if common:
                    yield paths[0][:common]
                    done = sum(len(self.tokens[t]) for t in paths[0][:common])
                    last = [-1, *last[done + 1 :]]
                due = len(last) + self.lookahead
        yield self.path(last, len(last) - 1)

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) > self.lookahead:
            return [t for sure in self.emit(piece) for t in sure]
        return self.search(piece)

    def search(self, piece: bytes) -> list[int]:
        """The piece's tokens by the same local rule without states: on with the longest token that goes with the last one, back
        where none does. What goes together so far is the one encoding of its bytes, so no place is come to twice."""
        rank, pairs, reach, n = self.rank.get, self._pair.get, self.reach.get, len(piece)
        found, last, at, end = [], self.start, 0, reach(piece[:HEAD], HEAD - 1)
        while at < n:
            if end > n:
                end = n
            while end > at:
                if (token := rank(piece[at:end])) is not None:
                    if (ok := pairs(last << 32 | token)) is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                end -= 1
            else:
                if not found:
                    raise ValueError("the ranks lack a single byte")
                end = at - 1
                at -= len(self.tokens[found.pop()])
                last = found[-1] if found else self.start
                continue
            found.append(token)
            last, at, end = token, end, end + reach(piece[end : end + HEAD], HEAD - 1)
        return found


#: Fixed value: the pattern whose pieces hold a space only as their first character, unless white space follows it.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space that white space or the end follows.
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


class Memo(dict):
    """Strings to packed little-endian ids; what is missing is made, and kept while there's room.

    When half the room is taken what is held grows old, and what was old and not asked for since goes.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.bytes = make, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        if (ids := self.old.get(text)) is None:
            ids = self.make(text)
        if len(text) <= LONG_PIECE:
            size = getsizeof(text) + getsizeof(ids) + ENTRY_BYTES
            if 2 * (self.bytes + size) > MEMO_BYTES:
                self.old = dict(self)
                self.clear()
                self.bytes = 0
            self[text] = ids
            self.bytes += size
        return ids


class Encoder:
    """Texts to packed ids: the transducer on each piece of the pattern, behind a bounded memo.

    With ``SPACE_LED`` a text without a loose space falls apart before every space, whatever stands around it;
    so the memo holds what begins with a space and runs to the next one, beside the pattern's pieces (each is its own only
    piece), and the pattern only runs on what is new.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.machine = Transducer(tokens)
        self.find = regex.compile(pattern).findall
        self.space_led = pattern == SPACE_LED
        self.memo = Memo(self.by_space if self.space_led else self.by_machine)

    def by_machine(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_space(self, text: str) -> bytes:
        found = self.find(text)
        return self.by_machine(text) if len(found) == 1 else b"".join(map(self.memo.__getitem__, found))

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if not self.space_led or "\0" in text or LOOSE_SPACE.search(text):
            return self.by_pattern(text)
        return b"".join(map(self.memo.__getitem__, text.replace(" ", "\0 ").split("\0")))


class Utf8Stream:
    """An incremental UTF-8 automaton: ``feed`` gives the characters complete so far and keeps an open one's bytes."""

    def __init__(self):
        self.open = b""

    @staticmethod
    def tail(data: bytes) -> int:
        """Bytes at the end that may begin a character still open: the automaton's state."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if need <= back:
                return 0
            if back > 1:  # the second byte's range rules out overlong forms, surrogates and what is past U+10FFFF
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.open + chunk
        cut = len(data) - self.tail(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.open = self.open, b""
        return data.decode("utf-8", "replace")


def decode_chunks(ids: np.ndarray, tokens: list[bytes], size: int = 65_536) -> Iterator[bytes]:
    """The bytes of ids, a bounded chunk at a time."""
    for k in range(0, len(ids), size):
        yield b"".join(map(tokens.__getitem__, ids[k : k + size].tolist()))


def decode_text(chunks: Iterable[bytes]) -> str:
    stream = Utf8Stream()
    return "".join([*map(stream.feed, chunks), stream.end()])


_MACHINES: dict[str, Encoder] = {}


def machine(tokens: list[bytes], pattern: str) -> Encoder:
    """The worker's encoder: kept between tasks, so that its states are made once."""
    key = hashlib.sha1(pattern.encode() + b"\0".join(tokens)).hexdigest()
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Encoder(tokens, pattern)
    return _MACHINES[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ids (array of int) and n_tokens."""
    return _mapped(df, "ids array<int>, n_tokens bigint", _encode_batch, ranks_path, pattern, text_col)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with decoded (string) from an array of ids; a null array counts as empty."""
    return _mapped(df, "decoded string", _decode_batch, ranks_path, "", ids_col)


def tokenise(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ids, n_tokens and round_trip: whether the ids decode to the text (null: empty)."""
    return _mapped(df, "ids array<int>, n_tokens bigint, round_trip boolean", _tokenise_batch, ranks_path, pattern, text_col, drop=True)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens and the digests of the ids and of the bytes that they decode to; ids never leave the worker."""
    return _mapped(df, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _round_trip_batch, ranks_path, pattern, text_col)


def _mapped(df: DataFrame, new: str, work, ranks_path: str, pattern: str, col: str, drop: bool = False) -> DataFrame:
    """The vocabulary (bounded: one file of ranks) is read on the driver and broadcast."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = [x.split()[0] for x in new.split(", ")]
    kept = df.drop(*names)
    at = kept.columns.index(col) if col in kept.columns else -1
    if at < 0:  # the column that is read is itself replaced
        raise ValueError(f"{col} is also a result's name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        encoder = machine(tokens, pattern) if pattern else None
        for batch in batches:
            for part in pieces(batch, at, BATCH_BYTES):
                made = work(part.column(at), encoder, tokens)
                held = part.drop_columns([f"c{at}"]) if drop else part
                yield pa.RecordBatch.from_arrays([*held.columns, *made], names=[*held.schema.names, *names])

    return with_arrow(kept, run, new, col if drop else None)


def _encode_batch(texts: pa.Array, encoder: Encoder, tokens: list[bytes]) -> list[pa.Array]:
    packed = [encoder.encode(t.as_py() or "") for t in texts]
    flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
    counts = np.array([len(x) // 4 for x in packed], np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(counts)]


def _tokenise_batch(texts: pa.Array, encoder: Encoder, tokens: list[bytes]) -> list[pa.Array]:
    ids, counts = _encode_batch(texts, encoder, tokens)
    same, flat, ends = [], ids.values.to_numpy(), ids.offsets.to_numpy()
    for k, t in enumerate(texts):
        same.append(decode_text(decode_chunks(flat[ends[k] : ends[k + 1]], tokens)) == (t.as_py() or ""))
    return [ids, counts, pa.array(same, pa.bool_())]


def _decode_batch(ids: pa.Array, encoder: Encoder | None, tokens: list[bytes]) -> list[pa.Array]:
    return [pa.array([decode_text(decode_chunks(np.array(x.as_py() or [], np.int64), tokens)) for x in ids], pa.string())]


def _round_trip_batch(texts: pa.Array, encoder: Encoder, tokens: list[bytes]) -> list[pa.Array]:
    counts, ids_sha, decoded_sha = [], [], []
    for t in texts:
        packed = encoder.encode(t.as_py() or "")
        counts.append(len(packed) // 4)
        ids_sha.append(hashlib.sha256(packed).hexdigest())
        digest, stream = hashlib.sha256(), Utf8Stream()
        for chunk in decode_chunks(np.frombuffer(packed, "<u4"), tokens):
            digest.update(stream.feed(chunk).encode())
        digest.update(stream.end().encode())
        decoded_sha.append(digest.hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]


def default_vocabulary() -> tuple[str, str]:
    """The production vocabulary: path of its ranks, and the pattern that cuts texts into pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens: their number, and the digests of the ids and of the decoded bytes."""
    path, pattern = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return round_trip(docs, path, pattern).drop("text")

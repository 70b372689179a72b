"""A hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

P(word | history) = P(group) * P(class | group) * P(bucket | class) * P(word | bucket), each but the last given the history.
The HEAD most frequent tokens are classes of their own, all other words fall into CLASSES - HEAD classes by a
hash of their last three bytes; WIDTH classes in order are a group; inside a class a word falls into one of BUCKETS
buckets by its first three bytes and its length. So a token costs softmaxes over 8, 8 and 16 outcomes, not one over all.

Groups and classes have a bias and four features of the history: the hashed previous word, the n-gram of
the two previous words' classes, and two skip features, the classes of the third and fourth and of the fifth and sixth
word back. Buckets, which tell words of a class apart, have a bias, the hashed previous word and, skipping it, the class of
the word before. Inside a bucket the word's count is the only feature: (count + 1) / (tokens + words + 1), one outcome being any
unknown word of the bucket. So all outcomes sum to 1.

Training takes distributed gradient steps. In each, every task works out the gradient on its documents (observed minus
expected counts of each feature with each outcome) in numpy batches; stretches of it are summed by shuffles, a bounded number of
tasks' sums at a time, and the driver applies the step, scaled for each weight by what it expects. At weights of zero the expected counts are known without
a softmax, so the start gathers observed counts only and takes the log of their ratio to the expected; ``PASSES``
gradient steps follow, so the documents are read 1 + PASSES times for the weights. The hashed words have ``KIND`` slots at
least, doubled with the counted tokens up to ``MOST_SLOTS``; so the model is a table of bounded size, the only thing broadcast
besides the lexicon: the most frequent words down to a count that at most ``LEXICON`` words reach, found from a
histogram of the counts.

Counts cover the whole training part: tasks count in bounded dictionaries, a shuffle adds up. The counts of
frequent words travel in the lexicon; a document's other words are joined to the count table, so the table may have any
size and no hot word is shuffled once a document.

Defined cases: a null text counts as empty and is one token, the end; a null id is in training; rows that repeat are
documents of their own; with no training rows all counts are 0 and classes are equally likely; an empty table gives
an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lean, ship, stage, table

#: The end of a text as a token; no word holds a space.
END = b" "

HEAD = 16
CLASSES = 64
#: Classes of a group, and groups.
WIDTH = 8
GROUPS = CLASSES // WIDTH
BUCKETS = 16
#: Numbers of the bucket's two features: hashed previous word, class of the word before it.
NEAR = 512
#: Numbers of a feature: all pairs of classes fit, words are hashed.
KIND = 4096
KINDS = 4
#: The hashed words' numbers come last and double while they'd have more training tokens each, up to so many.
TOKENS_A_SLOT = 1024
MOST_SLOTS = 8192
LEXICON = 65_536
PASSES = 2
#: Pseudo-count that holds back weights of rare features.
SMOOTH = 20.0
#: The features overlap, so that the log odds of each count in part at the start.
START = 0.4

COUNTER_WORDS = 200_000
#: Characters whose tokens are laid out at once, unless one text has more.
GROUP_CHARS = 800_000
TOKENS_AT_ONCE = 16_384
#: Numbers of a stretch of the summed table, and tasks whose stretches are summed at once.
STRETCH = 65_536
FAN_IN = 64
#: Log-spaced steps of the counts' histogram, to a doubling.
STEPS = 8


_BASE, _SALT = 0x9E3779B97F4A7C15, np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_END_HASH = np.uint64(0xE7D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tokens_of(text: str | None) -> list[bytes]:
    found = (text or "").encode().lower().split()  # bytes: lower() takes A-Z, split() the ASCII white space
    found.append(END)
    return found


def class_number(last: np.ndarray | int) -> np.ndarray | int:
    """The class of words outside the head, from their last three bytes as a number; ``class_column`` is the same in SQL."""
    return HEAD + ((last * 2654435761) >> 15) % (CLASSES - HEAD)


def class_column(word: Column) -> Column:
    last = F.conv(F.hex(F.substring(word, -3, 3)), 16, 10).cast("bigint")
    return F.lit(HEAD).cast("bigint") + F.shiftright(last * F.lit(2654435761).cast("bigint"), 15) % (CLASSES - HEAD)


def bucket_number(first: np.ndarray | int, size: np.ndarray | int) -> np.ndarray | int:
    """The bucket of words from their first three bytes as a number and their length; ``bucket_column`` is the same in SQL."""
    return ((first * 2246822519 + size * 3266489917) >> 17) % BUCKETS


def bucket_column(word: Column) -> Column:
    first = F.conv(F.hex(F.substring(word, 1, 3)), 16, 10).cast("bigint")
    return F.shiftright(first * F.lit(2246822519).cast("bigint") + F.octet_length(word) * F.lit(3266489917).cast("bigint"), 17) % BUCKETS


class Powers:
    """Powers of the hash's base and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class Tokens:
    """The tokens of some texts as arrays, without an object for each word: hash, class before the head, bucket, where texts start.

    ``word`` gives a token's bytes; ends of texts have their own hash.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode().lower() for t in texts]
        self.data = b"\n".join([*raw, b""])
        edges = np.cumsum([len(x) + 1 for x in raw])
        a = np.frombuffer(self.data, np.uint8)
        inside = ~_SPACE[a]
        change = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.start, self.stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        up, down = _POWERS.upto(len(a) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SALT[a] * up[:-1], dtype=np.uint64)])
        h = (sums[self.stop] - sums[self.start]) * down[self.start]
        h ^= h >> np.uint64(29)
        last = a[self.stop - 1].astype(np.int64)
        for k in (2, 3):
            at = self.stop - k
            last += np.where(at >= self.start, a[np.maximum(at, 0)].astype(np.int64) << (8 * (k - 1)), 0)
        first = a[self.start].astype(np.int64)
        for k in (1, 2):
            at = self.start + k
            inside_word = at < self.stop
            first = np.where(inside_word, (first << 8) + a[np.minimum(at, len(a) - 1)], first)
        text = np.searchsorted(edges, self.start, side="right")
        n = np.bincount(text, minlength=len(raw)) + 1
        self.starts = np.cumsum(n) - n
        place = np.arange(len(text)) + text
        self.hash = np.full(len(text) + len(raw), _END_HASH)
        self.hash[place] = h
        self.cls = np.full(len(self.hash), class_number(END[0]), np.int64)
        self.cls[place] = class_number(last)
        self.bucket = np.full(len(self.hash), bucket_number(END[0], 1), np.int64)
        self.bucket[place] = bucket_number(first, self.stop - self.start)
        self.at = np.full(len(self.hash), -1)
        self.at[place] = np.arange(len(text))

    def word(self, k: int) -> bytes:
        at = self.at[k]
        return END if at < 0 else self.data[self.start[at] : self.stop[at]]


def hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of words, the end of a text among them."""
    plain = [w for w in words if w != END]
    found = iter(Tokens([b"\n".join(plain).decode("utf-8", "surrogateescape")]).hash[:-1].tolist() if plain else [])
    return np.array([int(_END_HASH) if w == END else next(found) for w in words], np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            seen.update(tokens_of(text.as_py()))
            if len(seen) > COUNTER_WORDS:
                yield told()
    if seen:
        yield told()


def word_slots(tokens: int) -> int:
    """Numbers of the hashed words for so many training tokens."""
    slots = KIND
    while slots < MOST_SLOTS and slots * TOKENS_A_SLOT < tokens:
        slots *= 2
    return slots


def features(h: np.ndarray, c: np.ndarray, starts: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature numbers of each token, a row for each kind, for groups and classes, and for buckets; from the tokens' hashes and classes and where texts start; 0 stands before a text."""
    place = np.arange(len(c)) - np.repeat(starts, np.diff([*starts, len(c)]))

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        out[place < k] = 0
        return out

    word = (back(h, 1) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    pairs = [(back(c, k) * CLASSES + back(c, k + 1)) % KIND for k in (1, 3, 5)]
    far = np.stack([*(KIND * j + x for j, x in enumerate(pairs)), KIND * len(pairs) + (word % np.uint64(slots)).astype(np.int64)])
    return far, np.stack([(word % np.uint64(NEAR)).astype(np.int64), NEAR + back(c, 2)])


class Level:
    """One softmax of the factoring: its table of weights, a row for each feature in each context (what is chosen before), and the bias rows behind."""

    def __init__(self, edges: list[int], contexts: int, width: int):
        """edges: where the kinds' feature numbers start and end."""
        self.edges, self.contexts, self.width = edges, contexts, width
        self.kinds = len(edges) - 1
        self.rows = (edges[-1] + 1) * contexts
        self.weights = np.zeros((self.rows, width), np.float32)

    def rows_of(self, f: np.ndarray, context: np.ndarray | int) -> np.ndarray:
        """Row numbers in the table: of the features, a line for each kind, and last of the bias."""
        rows = np.empty((self.kinds + 1, f.shape[1]), np.int64)
        np.multiply(f, self.contexts, out=rows[:-1])
        rows[-1] = self.edges[-1] * self.contexts
        rows += context
        return rows

    def stretches(self) -> list[tuple[int, int]]:
        """First and last-but-one row of each kind, the bias last."""
        ends = [*self.edges, self.edges[-1] + 1]
        return [(a * self.contexts, b * self.contexts) for a, b in zip(ends, ends[1:], strict=False)]

    def lay(self) -> None:
        """Lay the weights out by outcome, as the sums below read them."""
        self.by_outcome = np.ascontiguousarray(self.weights.T, np.float32)

    def sides(self, rows: np.ndarray) -> np.ndarray:
        """Weights summed, a line for each outcome, less each token's largest."""
        z, part = np.empty((self.width, rows.shape[1]), np.float32), np.empty(rows.shape[1], np.float32)
        for line, of_outcome in zip(z, self.by_outcome, strict=True):
            np.take(of_outcome, rows[0], out=line, mode="clip")
            for at in rows[1:]:
                np.take(of_outcome, at, out=part, mode="clip")
                line += part
        z -= z.max(axis=0)
        return z

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        p = self.sides(rows)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def log_probability(self, rows: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's outcome."""
        z = self.sides(rows)
        return z[outcome, np.arange(z.shape[1])] - np.log(np.exp(z).sum(axis=0))

    def observe(self, total: np.ndarray, rows: np.ndarray, outcome: np.ndarray) -> None:
        """Add the counts of outcomes to a table by outcome."""
        for at, (low, high) in zip(rows, self.stretches(), strict=True):
            size = high - low
            total[:, low:high] += np.bincount(outcome * size + (at - low), minlength=size * self.width).reshape(self.width, size)

    def expect(self, total: np.ndarray, rows: np.ndarray) -> None:
        """Add the expected counts of outcomes to a table by outcome."""
        p = np.empty((self.width, rows.shape[1]))
        for i in range(0, rows.shape[1], TOKENS_AT_ONCE):
            p[:, i : i + TOKENS_AT_ONCE] = self.probabilities(rows[:, i : i + TOKENS_AT_ONCE])
        for at, (low, high) in zip(rows, self.stretches(), strict=True):
            at = at - low
            for k, weight in enumerate(p):
                total[k, low:high] += np.bincount(at, weights=weight, minlength=high - low)

    def start(self, seen: np.ndarray) -> None:
        """Log odds of the observed counts against those of the bias alone, smoothed; they count in part, as the features overlap."""
        bias = seen[-self.contexts :] + 0.5
        share = bias / bias.sum(axis=1, keepdims=True)
        alone = np.tile(share, (self.edges[-1], 1))
        held = seen[: -self.contexts]
        odds = np.log((held + SMOOTH * alone) / (held.sum(axis=1, keepdims=True) + SMOOTH)) - np.log(alone)
        self.weights = np.concatenate([START * odds, np.log(share)]).astype(np.float32)

    def step(self, seen: np.ndarray, hoped: np.ndarray) -> None:
        """Gradient over expected count; the features share a token's error; bounded steps."""
        step = np.clip((seen - hoped) / (hoped + SMOOTH), -1.5, 1.5) / self.kinds
        step[-self.contexts :] = np.clip(step[-self.contexts :] * self.kinds, -0.5, 0.5) / 4
        self.weights = (self.weights + step).astype(np.float32)


class Trained:
    """What scoring needs; all of bounded size: the head's and the lexicon's words as hashes, and the weights."""

    def __init__(self, top: list[tuple[bytes, int]], log_room: np.ndarray, slots: int):
        self.head = hashes([w for w, _ in top[:HEAD]])
        known = hashes([w for w, _ in top])
        order = np.argsort(known)
        self.known, self.logs = known[order], np.log10(np.array([n for _, n in top], np.float64) + 1)[order]
        #: log10 of each bucket's tokens, words and one, a row for each class.
        self.log_room = log_room
        self.slots = slots
        far = [*(KIND * j for j in range(KINDS)), KIND * (KINDS - 1) + slots]
        self.levels = [Level(far, 1, GROUPS), Level(far, GROUPS, WIDTH), Level([0, NEAR, NEAR + CLASSES], CLASSES, BUCKETS)]

    def choices(self, tokens: Tokens) -> Iterator[tuple[Level, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the tokens that it tells apart, their rows and outcomes. A word of the head has its class alone."""
        c = self.classes(tokens)
        far, near = features(tokens.hash, c, tokens.starts, self.slots)
        every, inside = np.arange(len(c)), np.flatnonzero(c >= HEAD)
        group = c // WIDTH
        yield self.levels[0], every, self.levels[0].rows_of(far, 0), group
        yield self.levels[1], every, self.levels[1].rows_of(far, group), c % WIDTH
        yield self.levels[2], inside, self.levels[2].rows_of(near[:, inside], c[inside]), tokens.bucket[inside]

    def log_factors(self, tokens: Tokens) -> np.ndarray:
        """log10 of the probability of each token's bucket, less that of the bucket's room."""
        out = np.zeros(len(tokens.hash))
        for level, at, rows, outcome in self.choices(tokens):
            for k in range(0, len(at), TOKENS_AT_ONCE):
                part = slice(k, k + TOKENS_AT_ONCE)
                out[at[part]] += level.log_probability(rows[:, part], outcome[part])
        c = tokens.cls
        return out / math.log(10) - self.log_room[c, np.where(c < HEAD, 0, tokens.bucket)]

    def classes(self, tokens: Tokens) -> np.ndarray:
        c = tokens.cls
        for k, h in enumerate(self.head):
            c[tokens.hash == h] = k
        return c

    def log_counts(self, tokens: Tokens) -> np.ndarray:
        """log10(count + 1) of the words in the lexicon; NaN for others."""
        if not len(self.known):
            return np.full(len(tokens.hash), math.nan)
        at = np.minimum(np.searchsorted(self.known, tokens.hash), len(self.known) - 1)
        return np.where(self.known[at] == tokens.hash, self.logs[at], math.nan)


def grouped(texts: Iterable[str | None]) -> Iterator[Tokens]:
    """Whole texts in groups of about GROUP_CHARS characters; a longer text is a group."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield Tokens(group)
            group, size = [], 0
    if group:
        yield Tokens(group)


def _sums(shared: Broadcast, expected: bool):
    """Stretches of the levels' tables of observed (or expected) counts of features with outcomes, and the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trained = shared.value
        totals = [np.zeros((level.width, level.rows)) for level in model.levels]
        for level in model.levels:
            level.lay()
        for batch in batches:
            for tokens in grouped(t.as_py() for t in batch.column(0)):
                for total, (level, _, rows, outcome) in zip(totals, model.choices(tokens), strict=True):
                    if expected:
                        level.expect(total, rows)
                    else:
                        level.observe(total, rows, outcome)
        flat = np.concatenate([t.T.ravel() for t in totals]).astype(np.float32)
        parts = [flat[k : k + STRETCH].tobytes() for k in range(0, len(flat), STRETCH)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["stretch", "task", "vals"])

    return run


def _add(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for v in part["vals"])
    return pa.table({"stretch": part["stretch"][:1], "task": part["task"][:1], "vals": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def table_of(train: DataFrame, model: Trained, expected: bool) -> list[np.ndarray]:
    """The levels' summed tables, on the driver: as many numbers as the model has weights. FAN_IN tasks' sums meet at a time."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    schema = "stretch int, task int, vals binary"
    parts = train.mapInArrow(lean(_sums(shared, expected)), schema)
    tasks = max(1, train.rdd.getNumPartitions())
    while tasks > 0:
        tasks = 0 if tasks <= FAN_IN else -(-tasks // FAN_IN)
        parts = parts.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("stretch", "task").applyInArrow(_add, schema)
    found = {r["stretch"]: np.frombuffer(r["vals"], np.float32) for r in parts.collect()}
    shared.unpersist()
    size = sum(level.weights.size for level in model.levels)
    flat = np.concatenate([found[k] for k in range(len(found))]).astype(np.float64) if found else np.zeros(size)
    ends = np.cumsum([level.weights.size for level in model.levels])
    return [x.reshape(level.weights.shape) for x, level in zip(np.split(flat, ends[:-1]), model.levels, strict=True)]


def train_classes(train: DataFrame, model: Trained) -> Trained:
    """Fit the weights on all training texts."""
    seen = table_of(train, model, expected=False)
    for level, x in zip(model.levels, seen, strict=True):
        level.start(x)
    for _ in range(PASSES):
        for level, x, hoped in zip(model.levels, seen, table_of(train, model, expected=True), strict=True):
            level.step(x, hoped)
    return model


def _scored(shared: Broadcast):
    """Per text: tokens, what the lexicon and the classes tell, and the words that must be looked up, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trained = shared.value
        for level in model.levels:
            level.lay()
        for batch in batches:
            n_tokens, n_known, logs, classes, rare, times = [], [], [], [], [], []
            for tokens in grouped(t.as_py() for t in batch.column(2)):
                log, starts = model.log_counts(tokens), tokens.starts
                factors = model.log_factors(tokens)
                known = ~np.isnan(log)
                logs += np.add.reduceat(np.where(known, log, 0.0), starts).tolist()
                n_known += np.add.reduceat((known & (log > 0)).astype(np.int64), starts).tolist()
                classes += np.add.reduceat(factors, starts).tolist()
                ends = np.append(starts[1:], len(log))
                n_tokens += (ends - starts).tolist()
                unsure = np.flatnonzero(~known)
                cuts = np.searchsorted(unsure, ends)
                for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    seen = Counter(tokens.word(k) for k in unsure[a:b].tolist())
                    rare.append(list(seen.keys()))
                    times.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()), pa.array(classes, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes", "rare", "times"])

    return run


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The words of all counts down to one that at most LEXICON words reach, the most frequent first; the first HEAD whatever their counts."""
    step = F.floor(F.log2("n") * STEPS)
    held = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, room = None, LEXICON
    for r in sorted(held, key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    first = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    rest = counts.where(F.col("n") >= least).collect() if least is not None else []
    found = {bytes(r["word"]): r["n"] for r in [*first, *rest]}
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out to the contract's columns; learns from the rows that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    train = docs.where("not held_out").select("text")
    counted = train.mapInArrow(lean(_count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counted, "counts")
    top = most_frequent(counts)
    head = [w for w, _ in top[:HEAD]]
    # The bucket's room: its tokens, its words and one for the unknown. A class of the head has one bucket.
    place = F.coalesce(*(F.when(F.col("word") == F.lit(bytearray(w)), F.lit(i).cast("bigint")) for i, w in enumerate(head)), class_column(F.col("word")))
    room = np.ones((CLASSES, BUCKETS))
    tokens = words = 0
    for r in counts.groupBy(place.alias("c"), F.when(place < HEAD, 0).otherwise(bucket_column(F.col("word"))).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        room[r["c"], r["b"]] += r["n"] + r["words"]
        tokens += r["n"]
        words += r["words"]
    model = train_classes(train, Trained(top, np.log10(room), word_slots(tokens)))
    shared = spark.sparkContext.broadcast(model)
    told = docs.select("doc_id", "held_out", "text").mapInArrow(lean(_scored(shared)), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, classes double, rare array<binary>, times array<bigint>")
    told = stage(told.withColumn("rid", F.monotonically_increasing_id()), "scored")
    asked = told.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = asked.join(counts, "word").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    joined = told.join(found, "rid", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), (logs - F.col("n_tokens") * math.log10(tokens + words + 1)).alias("base_score"), (logs + F.col("classes")).alias("score"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's and the base's log10 probability of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return score_documents(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out")))

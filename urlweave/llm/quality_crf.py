"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line is described by shares and ratios of its own text (no words, no ids) and by the same
numbers of the line before and the line after; the field adds a weight for each pair of neighbouring labels. It
is fitted by conditional likelihood, the lines of a labelled document all carrying its label. A document's score is
the mean of its lines' forward-backward marginals of "good", weighted by their length.

Fitting uses a bounded sample of whole documents: the labelled ones whose ids hash lowest, ``FIT_DOCS`` at most and as many as
have ``FIT_DOCS * FIT_LINES`` lines together (one with more than that alone is passed over); so the driver holds a bounded table of
numbers. All their lines are described, from the whole text; chains are fitted in pieces of ``FIT_LINES`` lines. Scoring reads every line of every text in Arrow batches.

Defined cases: a null or empty text is one empty line; lines end at a line feed; labels that are neither 0 nor 1
are not used, and of several labels of one id the largest holds; without labels every score is 0.5; a null id is
not held out; rows that repeat are scored alike; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lean, ship, table, with_arrow

FIT_DOCS = 4000
FIT_LINES = 200
FIT_STEPS = 400
RIDGE = 1e-4

#: Lines that are scored at once.
LINES_AT_ONCE = 20_000

_UPPER, _DIGIT, _STOP, _MARK, _HIGH = (re.compile(x) for x in (r"[A-ZÀ-Þ]", r"[0-9]", r"[.,;:?'\"-]", r"[^\w\s.,;:?'\"-]", r"[^\x00-\x7f]"))
_MARKED = re.compile(r"[^\w\s.,;:?'\"-]{2,}")


def describe(line: str, often: int) -> list[float]:
    """The numbers of one line; often: how many times the document has it."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    letters = sum(map(len, words))
    counts = Counter(words)
    most = max(counts.values())
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    end = line.rstrip()[-1]
    return [
        np.log1p(size) / 5,
        np.log1p(n) / 4,
        letters / n / 10,
        len(_UPPER.findall(line)) / letters,
        len(_DIGIT.findall(line)) / letters,
        len(_STOP.findall(line)) / n,
        len(_MARK.findall(line)) / letters,
        len(_MARKED.findall(line)) / n,
        line.count("|") / n,
        line.count("!") / n,
        len(_HIGH.findall(line)) / letters,
        (size - letters) / size,
        len(counts) / n,
        most / n,
        again / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        sum(len(w) <= 3 for w in words) / n,
        max(map(len, counts)) / 20,
        sum(w[0].isupper() for w in words) / n,
        float(line.lstrip()[0].isupper()),
        float(end == "."),
        float(end in "!?"),
        float(often > 1),
        float(n < 4),
        0.0,
    ]


N_FEATURES = 25


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features with the neighbours' and a bias, lengths) of a text."""
    lines = (text or "").split("\n")
    seen = Counter(lines)
    own = np.array([describe(x, seen[x]) for x in lines], np.float32)
    edge = np.zeros((1, N_FEATURES), np.float32)
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    size = np.array([len(x) for x in lines], np.float64)
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1), size


WIDTH = 3 * N_FEATURES + 1


class Field:
    """Weights of "good" against "bad" for a line's features, and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.pairs, self.mean, self.scale = weights, pairs, mean, scale

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def marginals(self, score: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """P(good) of each line; ends: where each document's lines end in ``score``."""
        laid = _laid(score, ends)
        return _marginals(laid[0], laid[1], self.pairs)[0][laid[1]]


def _laid(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents as rows of a padded table, and the mask of its places in use."""
    sizes = np.diff(ends, prepend=0)
    mask = np.arange(max(sizes, default=0)) < sizes[:, None]
    out = np.zeros(mask.shape)
    out[mask] = values
    return out, mask


def _marginals(score: np.ndarray, mask: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over the rows: P(good), expected label pairs, and the log partition of each row."""
    rows, steps = score.shape
    node = np.stack([np.zeros_like(score), score], axis=2)
    forward = np.zeros((steps, rows, 2))
    forward[0] = node[:, 0]
    for t in range(1, steps):
        step = np.logaddexp.reduce(forward[t - 1][:, :, None] + pairs, axis=1) + node[:, t]
        forward[t] = np.where(mask[:, t, None], step, forward[t - 1])
    total = np.logaddexp.reduce(forward[-1], axis=1)
    backward = np.zeros((steps, rows, 2))
    both = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        ahead = node[:, t + 1] + backward[t + 1]
        step = np.logaddexp.reduce(pairs + ahead[:, None, :], axis=2)
        on = mask[:, t + 1]
        backward[t] = np.where(on[:, None], step, 0.0)
        joint = forward[t][:, :, None] + pairs + ahead[:, None, :] - total[:, None, None]
        both += np.exp(joint[on]).sum(axis=0)
    good = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total, 0.0)).T
    return good, both, total


def fit(docs: list[tuple[np.ndarray, int]]) -> Field | None:
    """By Adam on the mean log likelihood of documents; docs: (lines x features, label)."""
    if not docs:
        return None
    docs = sorted(docs, key=lambda d: len(d[0]))
    x = np.concatenate([d[0] for d in docs]).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0.0, 1.0
    x = (x - mean) / scale
    sizes = np.array([len(d[0]) for d in docs])
    ends = np.cumsum(sizes)
    label = np.repeat([float(d[1]) for d in docs], sizes)
    # Rows of like length together, so that padding stays small.
    cuts = [0, *[k for k in range(1, len(docs)) if sizes[k] > 2 * sizes[k - 1] or k % 512 == 0], len(docs)]
    parts = [(a, b, slice(ends[a - 1] if a else 0, ends[b - 1])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    seen_pairs = np.zeros((2, 2))
    for d in docs:
        seen_pairs[d[1], d[1]] += len(d[0]) - 1
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, FIT_STEPS + 1):
        weights, pairs = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        score, good, both = x @ weights, np.empty(len(x)), np.zeros((2, 2))
        for a, b, lines in parts:
            laid, mask = _laid(score[lines], ends[a:b] - lines.start)
            p, pair, _ = _marginals(laid, mask, pairs)
            good[lines] = p[mask]
            both += pair
        slope = np.concatenate([x.T @ (label - good), (seen_pairs - both).ravel()]) / len(x) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), mean, scale)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [line_features(t.as_py())[0].tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.binary())], names=["doc_id", "quality", "lines"])


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Fit on labelled documents: docs (doc_id, text), labels (doc_id, quality) of the training part."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Rows that repeat an id come and go together.
    sizes = texts.groupBy("doc_id").agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("n"), F.xxhash64("doc_id").alias("rank")).collect()
    room, chosen = FIT_DOCS * FIT_LINES, []
    for r in sorted((r for r in sizes if r["n"] <= FIT_DOCS * FIT_LINES), key=lambda r: (r["rank"], r["doc_id"])):
        room -= r["n"]
        if room < 0:
            break
        chosen.append((r["doc_id"],))
    if len(chosen) < len(sizes):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint")), "doc_id", "left_semi")
    told = texts.select("doc_id", "quality", "text").mapInArrow(lean(_described), "doc_id bigint, quality int, lines binary")
    rows = sorted((r["doc_id"], bytes(r["lines"]), r["quality"]) for r in told.collect())
    whole = [(np.frombuffer(x, np.float32).reshape(-1, WIDTH), y) for _, x, y in rows]
    return fit([(x[k : k + FIT_LINES], y) for x, y in whole for k in range(0, len(x), FIT_LINES)])


def _scores(shared: Broadcast, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field | None = shared.value
        for batch in batches:
            out: list[float] = []
            group: list[tuple[np.ndarray, np.ndarray]] = []
            lines = 0
            for t in batch.column(at):
                told = line_features(t.as_py())
                if len(told[1]) > 64:  # long documents alone: padding is for like lengths
                    out += _weighted(field, group) + _weighted(field, [told])
                    group, lines = [], 0
                    continue
                group.append(told)
                lines += len(told[1])
                if lines >= LINES_AT_ONCE:
                    out += _weighted(field, group)
                    group, lines = [], 0
            out += _weighted(field, group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return run


def _weighted(field: Field | None, group: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    if not group or field is None:
        return [0.5] * len(group)
    ends = np.cumsum([len(s) for _, s in group])
    good = field.marginals(field.potentials(np.concatenate([x for x, _ in group])), ends)
    size = np.concatenate([s for _, s in group]) + 1.0  # a line counts with its line feed
    starts = np.concatenate([[0], ends[:-1]])
    return np.clip(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts), 0, 1).tolist()


def score_quality(docs: DataFrame, field: Field | None, name: str = "score") -> DataFrame:
    """``docs`` with the score as ``name``; the column ``text`` is read, an existing ``name`` replaced."""
    spark = docs.sparkSession
    ship(spark)
    kept = docs.drop(name)
    shared = spark.sparkContext.broadcast(field)
    return with_arrow(kept, _scores(shared, kept.columns.index("text"), name), f"{name} double")


def in_training() -> object:
    """Rows whose labels may be learnt from."""
    return F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and class; the rows whose checksum leaves 1 are held out."""
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(docs, labels.where(in_training()))
    scored = score_quality(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

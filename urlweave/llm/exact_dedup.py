"""Exact dedup against history by a minimal perfect hash.

Texts are equal when identical after white space goes. The distinct digests of the historical rows are cut
into buckets by digest; each bucket gets a minimal perfect hash whose slots hold the full digest and the
winner's locator (code points, id, rows). A distinct digest of the new rows looks up its one slot and is a
repeat only if all bytes of the digest there agree; the others are grouped on their own. Of equal rows, the one
with the most code points stays, then the smallest id.

Only (digest, id, length) is shuffled, never a text. Groups are counted with partial aggregates, so a digest that
a third of the rows share costs a task one row; the final join's hot keys are split by adaptive execution.

Defined cases: a null text counts as empty, and empty texts are equal to each other; a null id loses ties to
any id and may itself be the winner (keep_id null); rows that repeat an id and a text are both in the group,
and each of those that carry the winning id is kept; an empty history or table is fine; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, crc_mod, ship, stage, table

#: Rows whose distinct digests share a bucket, on average: what one task holds at a time, of history and new rows together.
BUCKET_KEYS = 50_000

INDEX_SCHEMA = "bucket int, level_bits array<binary>, digests binary, points binary, ids binary, id_known binary, counts binary"
INDEX_TYPE = pa.schema({"bucket": pa.int32(), "level_bits": pa.list_(pa.binary()), "digests": pa.binary(), "points": pa.binary(), "ids": pa.binary(), "id_known": pa.binary(), "counts": pa.binary()})
GROUP_SCHEMA = "digest binary, keep_id bigint, group_size bigint, in_history boolean"


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: cascading bitmaps, each holding the keys alone at their place."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.before = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in bits]
        self.start = np.cumsum([0] + [int(b.sum()) for b in bits])

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """A key's place at a level, from the four words of its digest."""
        step = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = words[:, level % 4] * step ^ (words[:, (level + 1) % 4] >> np.uint64(7))
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        bits, level = [], 0
        while len(words):
            size = max(8, 2 * len(words)) + level
            at = cls.place(words, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            words, level = words[~alone[at]], level + 1
        return cls(bits)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that the hash was not built from."""
        found = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for level, b in enumerate(self.bits):
            at = self.place(words[open_], level, len(b))
            hit = b[at]
            found[open_[hit]] = self.start[level] + self.before[level][at[hit]]
            open_ = open_[~hit]
        return found

    def packed(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.bits]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in levels])


def digest_rows(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code points of the whole text, the digest of the text without white space, and whether the row is history."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("points"), digest.alias("digest"), old.alias("old"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """A row for each distinct digest: its winner (not_id is the id's complement, so that the smallest id is the maximum) and count."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("not_id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("rows")).select("digest", "best.points", F.bitwise_not("best.not_id").alias("doc_id"), "rows")


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _whole(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column's 64-bit numbers (0 for nulls) and which are known; never by way of floats."""
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_valid().to_numpy().astype(bool)


def _build(part: pa.Table) -> pa.Table:
    """A bucket's index row: the hash, and its slots in order."""
    words = _words(part["digest"])
    hash_ = PerfectHash.build(words)
    order = np.argsort(hash_.slots(words))
    (points, _), (ids, known), (rows, _) = (_whole(part[c]) for c in ("points", "doc_id", "rows"))
    row = {"bucket": part["bucket"][0].as_py(), "level_bits": hash_.packed(), "digests": words[order].tobytes(), "points": points[order].tobytes(), "ids": ids[order].tobytes(), "id_known": known[order].tobytes(), "counts": rows[order].tobytes()}
    return pa.Table.from_pylist([row], INDEX_TYPE)


def _grouped(digests: list[bytes], ids: np.ndarray, known: np.ndarray, counts: np.ndarray, in_history: bool) -> pa.Table:
    columns = [pa.array(digests, pa.binary()), pa.array(ids, pa.int64(), mask=~known), pa.array(counts, pa.int64()), pa.array([in_history] * len(ids), pa.bool_())]
    return pa.Table.from_arrays(columns, names=["digest", "keep_id", "group_size", "in_history"])


def _lookup(new: pa.Table, index: pa.Table) -> pa.Table:
    """The bucket's groups: slots merged with the new digests that they hold, then the nonmembers."""
    (new_points, _), (new_ids, new_known), (new_rows, _) = (_whole(new[c]) for c in ("points", "doc_id", "rows"))
    member = np.zeros(len(new), bool)
    out = []
    if len(index):
        row = index.to_pylist()[0]
        raw = row["digests"]
        held = np.frombuffer(raw, "<u8").reshape(-1, 4)
        points, ids, counts = (np.frombuffer(row[k], np.int64).copy() for k in ("points", "ids", "counts"))
        known = np.frombuffer(row["id_known"], bool).copy()
        if len(new):
            words = _words(new["digest"])
            slot = PerfectHash.unpacked(row["level_bits"]).slots(words)
            member = (slot >= 0) & (held[slot] == words).all(axis=1)  # all 32 bytes, not only the slot
            s = slot[member]
            p, i, k = new_points[member], new_ids[member], new_known[member]
            wins = (p > points[s]) | (p == points[s]) & k & (~known[s] | (i < ids[s]))
            counts[s] += new_rows[member]
            points[s[wins]], ids[s[wins]], known[s[wins]] = p[wins], i[wins], k[wins]
        out.append(_grouped([raw[k : k + 32] for k in range(0, len(raw), 32)], ids, known, counts, True))
    rest = ~member
    out.append(_grouped(new["digest"].filter(pa.array(rest)).to_pylist(), new_ids[rest], new_known[rest], new_rows[rest], False))
    return pa.concat_tables(out)


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The staged index: a row for each bucket of the historical digests."""
    return stage(bucketed(groups, buckets).groupBy("bucket").applyInArrow(_build, INDEX_SCHEMA), "perfect_hash")


def resolve(new_groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Every digest of history or the new rows once, with its winner, its rows and whether history had it."""
    return bucketed(new_groups, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_lookup, GROUP_SCHEMA)


def exact_dedup(history: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of history and of docs: doc_id, keep_id, group_size, kept, text_sha256, in_history."""
    return dedup_rows(digest_rows(history, F.lit(True), id_col, text_col).unionByName(digest_rows(docs, F.lit(False), id_col, text_col)))


def dedup_rows(rows: DataFrame) -> DataFrame:
    """The same from ``digest_rows``."""
    ship(rows.sparkSession)
    rows = stage(rows, "digests")
    old = digest_groups(rows.where("old"))
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    groups = resolve(digest_groups(rows.where("not old")), build_index(old, buckets), buckets)
    joined = rows.join(groups, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def op9_exact_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for it.

    ``documents`` has no history of its own, so the rows whose id's crc32 is even (about half; null ids are new rows)
    play it. The result doesn't depend on the split: equal texts meet whether both are history, both new, or one each.
    """
    old = F.coalesce(crc_mod(F.col("doc_id"), 2) == 0, F.lit(False))
    found = dedup_rows(digest_rows(table(spark, sf_dir, "documents"), old))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

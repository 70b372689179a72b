"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

Words are what white space leaves of the text with A-Z lowered; a document's set holds its distinct shingles of
five words (the whole sequence if it has fewer, nothing if it has none). Two documents are linked if
100 * intersection >= 75 * union; a document's class is its connected component.

1. One pass over the texts gives each document the size and the digest of its set, 384 MinHash samples, of which 96
   make 32 band keys of three, and the odd sketch of all: a bitmap of 1024 bits in which every sample flips one.
   Equal sets are one node from here on. A pair at the threshold shares no band with probability
   (1 - 0.75^3)^32 = 2.4e-8, and the chance falls with similarity.
2. Star rounds: each node of a bucket is compared with the bucket's pivot unless both are in one component
   already; of a node's pivots the PIVOTS with the best sketches are confirmed. A bucket's pivot is its first node in
   one order of all nodes: in the first round by how many members the node meets in its buckets (the text that a
   family was copied from is like all of them, while they may not be like each other), then a random one. So the many
   buckets of a group share few pivots, and a group of g near copies costs about g confirmations, not g^2.
3. The rest, exactly: what remains are buckets that still mix components. A shingle is rare if at most RARE nodes of
   these buckets have it. Nodes that share a rare shingle are paired through it, which makes at most RARE pairs for
   each shingle of a node. Nodes that share none can have no more in common than the c frequent shingles of either, and a
   link of nodes of n and m shingles needs 75 (n + m) <= 175 c. Nodes for which not even the smallest set of their bucket
   allows that leave the bucket before anything is paired: in a family of copies with edits of their own these are the copies
   too far from all others. Of what is left every pair of different components whose sizes, c and sketches don't rule it
   out (parity bits as for a similarity under 0.58) is confirmed on the full sets.

Links are confirmed on full sets of 64-bit shingle hashes, made again in one pass from the texts of just the documents that
share a bucket (8 bytes a shingle, staged); those are fetched through a bitmap of at most ``BITMAP_WORDS`` words, the only thing that is
broadcast, then joined exactly. Components come from alternating large and small star steps over staged edges; up to ``LOCAL_EDGES``
edges, some bytes each, are joined up on the driver instead, with the same result: every star step costs the driver a dozen small stages.

Defined cases: null and empty texts and those without words have an empty set and are linked with nothing;
rows that repeat an id are separate documents with that id; a null id is never a class's smallest unless all
are null; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, stage, table

SHINGLE = 5
PERCENT = 75

SAMPLES = 384
BANDS, ROWS = 32, 3
SKETCH_BITS = 1024

#: Parity bits that differ at most: what a similarity of 0.58 makes them on average. At 0.75 their mean is 160 and their
#: standard deviation 16.5, so that a link passes but for a chance of about 1e-6.
SKETCH_DIFFER = 239

STAR_ROUNDS = 2
PIVOTS = 3

#: Nodes that have a rare shingle, at most.
RARE = 4

#: Words of the membership bitmap at most (64 bits each); a broadcast of 16 bytes for each.
BITMAP_WORDS = 1 << 20

#: Edges that the driver joins up itself, at most (16 bytes each).
LOCAL_EDGES = 250_000

MEMO_WORDS = 200_000

_M = 0xFFFFFFFFFFFFFFFF
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Words to 64-bit hashes: a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = (text or "").encode().lower().split()  # bytes: lower() takes A-Z, split() the ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = s * _P + h[j : len(h) - k + 1 + j]
    return np.unique(_mixed(s))


class Sampler:
    """MinHash samples of a set, their band keys and odd sketch."""

    def __init__(self):
        r = np.random.default_rng(20240229)
        self.a = (r.integers(0, 2**32, SAMPLES, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = r.integers(0, 2**32, SAMPLES, np.uint64).astype(np.uint32)
        self.band = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        self.sample = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32))

    def samples(self, s: np.ndarray, chunk: int = 8192) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), chunk):
            y = np.multiply.outer(self.a, x[k : k + chunk])
            y += self.b[:, None]
            np.minimum(least, y.min(axis=1), out=least)
        return least

    def bands(self, least: np.ndarray) -> np.ndarray:
        v = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        key = self.band
        for j in range(ROWS):
            key = _mixed(key * _P + v[:, j])
        return key.view(np.int64)

    def sketch(self, least: np.ndarray) -> np.ndarray:
        at = (_mixed(self.sample + least.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, sampler = WordHashes(), Sampler()
    for batch in batches:
        n, digests, bands, sketches = [], [], [], []
        for t in batch.column(1):
            s = shingle_set(t.as_py(), words)
            n.append(len(s))
            digests.append(_digest(s))
            if len(s):
                least = sampler.samples(s)
                bands.append(sampler.bands(least))
                sketches.append(sampler.sketch(least))
            else:
                bands.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "bands", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "members"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (z.values.to_numpy() for z in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _sizes_allow(n: Column, m: Column) -> Column:
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)


def _common_allows(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m members can be linked if at most ``common`` are in both."""
    return common * (100 + PERCENT) >= (n + m) * PERCENT


def _differ(x: str, y: str) -> Column:
    """Bits in which two sketches differ."""
    bits = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)]
    return sum(bits[1:], bits[0])


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node of its component."""
    if edges.count() > LOCAL_EDGES:
        return star_components(edges)
    told = edges.select("a", "b").toArrow()
    node, root = joined_up(*(np.asarray(told.column(c), np.int64) for c in ("a", "b")))
    return stage(edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root})), "roots")


def star_components(edges: DataFrame) -> DataFrame:
    """As ``components``, whatever the number of edges."""
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("m", "v").alias("m"))
        large = both.join(least, F.col("v") == F.col("k")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        small = large.join(low, F.col("v") == F.col("k")).select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = stage(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(now.select("u", "u").toDF("node", "root").distinct())


class Graph:
    """The staged tables of one run."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.rows = stage(self.docs.mapInArrow(lean(_signed), "doc_id bigint, n bigint, digest binary, bands array<bigint>, sketch array<bigint>"), "signed")
        sets = self.rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("min_doc"), F.first("doc_id").alias("some_doc"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        self.nodes = stage(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
        buckets = self.nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
        shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        met = stage(buckets.join(shared, "key"), "met")
        degree = met.groupBy("node").agg(F.sum("members").alias("degree"))
        self.shared = stage(met.drop("members").join(degree, "node"), "shared")
        self.sets = stage(self.fetched(degree.select("node")), "sets")
        self.edges: DataFrame | None = None
        self.roots: DataFrame | None = None

    def members(self) -> DataFrame:
        """Nodes of shared buckets with their components so far."""
        if self.roots is None:
            return self.shared.withColumn("root", F.col("node"))
        return self.shared.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def fetched(self, nodes: DataFrame) -> DataFrame:
        """The full sets (node, members) of some nodes, from the documents' texts."""
        wanted = stage(nodes.join(self.nodes.select("node", "digest", "some_doc"), "node"), "wanted")
        spot = F.pmod(F.xxhash64(F.coalesce("some_doc", F.lit(0))), F.lit(64 * BITMAP_WORDS))
        bitmap = wanted.select(spot.alias("spot")).groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
        docs = self.docs.withColumn("spot", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(64 * BITMAP_WORDS)))
        near = docs.join(F.broadcast(bitmap), F.expr("spot div 64") == F.col("word")).where("getbit(bits, cast(spot % 64 as int)) = 1")
        sets = near.select("text").mapInArrow(lean(_full_sets), "digest binary, members array<bigint>").dropDuplicates(["digest"])
        return wanted.select("node", "digest").join(sets, "digest").select("node", "members")

    def link(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b) that the full sets confirm."""
        sided = stage(pairs, "pairs").join(self.sets.toDF("a", "left"), "a").join(self.sets.toDF("b", "right"), "b").select("a", "b", "left", "right")
        found = stage(sided.mapInArrow(lean(_confirmed), "a bigint, b bigint"), "links")
        self.edges = found if self.edges is None else self.edges.unionAll(found)
        self.roots = components(self.edges)

    def star(self, turn: int) -> None:
        members = self.members()
        rank = [F.xxhash64("node", F.lit(turn)).alias("rank")]
        if turn == 0:
            rank = [(-F.col("degree")).alias("degree"), *rank]
        pivots = members.groupBy("key").agg(F.min(F.struct(*rank, "node", "root", "n")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        pairs = members.join(pivots, "key").where(F.col("root") != F.col("p.root")).where(_sizes_allow(F.col("n"), F.col("p.n"))).select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
        best = self._sketched(pairs).where(F.col("differ") <= SKETCH_DIFFER).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("differ", "b"))).alias("best"))
        self.link(best.select("a", F.explode(F.slice("best", 1, PIVOTS)).alias("p")).select("a", "p.b"))

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        known = self.nodes.select("node", "sketch")
        return pairs.join(known.toDF("a", "sa"), "a").join(known.toDF("b", "sb"), "b").select("a", "b", _differ("sa", "sb").alias("differ"))

    def rest(self) -> None:
        members = self.members().select("key", "band", "node", "n", "root")
        mixed = stage(members.join(self._mixing(members), "key", "left_semi"), "mixed")
        rare = stage(self._rare(mixed.select("node").distinct()), "rare")
        held = rare.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("rare"))
        # The shingles of a node that are frequent in these buckets.
        counted = mixed.join(held, "node", "left").withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0)))
        least = mixed.groupBy("key").agg(F.min("n").alias("least"))
        able = stage(counted.join(least, "key").where(_common_allows(F.col("common"), F.col("n"), F.col("least"))).drop("least", "rare"), "able")
        sketched = able.join(self._mixing(able), "key").join(self.nodes.select("node", "sketch", "bands"), "node")
        few = sketched.where("root <> main").select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("common").alias("ca"), F.col("sketch").alias("sa"), "band", F.col("bands").alias("ba"))
        other = sketched.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("common").alias("cb"), F.col("sketch").alias("sb"), F.col("bands").alias("bb"), (F.col("root") == F.col("main")).alias("in_main"))
        # A pair counts in the first band that it shares, not again in the others.
        first = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) == F.col("band") + 1
        fits = _sizes_allow(F.col("na"), F.col("nb")) & _common_allows(F.least("ca", "cb"), F.col("na"), F.col("nb")) & (_differ("sa", "sb") <= SKETCH_DIFFER)
        pairs = few.join(other, "key").where((F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & fits & first)
        through_buckets = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        both = F.flatten(F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        met = rare.where(F.size("nodes") > 1).select(F.explode(both).alias("p")).select("p.a", "p.b").distinct()
        told = mixed.select("node", "n", "root").distinct()
        met = met.join(told.toDF("a", "na", "ra"), "a").join(told.toDF("b", "nb", "rb"), "b").where((F.col("ra") != F.col("rb")) & _sizes_allow(F.col("na"), F.col("nb"))).select("a", "b")
        through_rare = self._sketched(met).where(F.col("differ") <= SKETCH_DIFFER).select("a", "b")
        self.link(through_buckets.unionAll(through_rare).distinct())

    @staticmethod
    def _mixing(members: DataFrame) -> DataFrame:
        """The buckets (key, main) whose members are of several components; main is the component of most members."""
        roots = members.groupBy("key", "root").agg(F.count("*").alias("size"))
        return roots.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")

    def _rare(self, nodes: DataFrame) -> DataFrame:
        """The nodes that have each shingle that at most RARE of them have."""
        each = self.sets.join(nodes, "node", "left_semi").select("node", F.explode("members").alias("shingle"))
        few = each.groupBy("shingle").agg(F.count("*").alias("held")).where(F.col("held") <= RARE).select("shingle")
        return each.join(few, "shingle").groupBy("shingle").agg(F.collect_list("node").alias("nodes"))

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row."""
        roots = self.nodes.select("node", "digest", "min_doc").join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Staged, so that the join's hot roots are read from an exchange of its own, which adaptive execution splits.
        least = stage(roots.groupBy("root").agg(F.min("min_doc").alias("component_id")), "least")
        of_set = roots.join(least, "root").select("digest", "component_id")
        linked = self.rows.select("doc_id", "n", "digest").join(of_set, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``; see the module's text."""
    graph = Graph(docs, id_col, text_col)
    for turn in range(STAR_ROUNDS):
        graph.star(turn)
    graph.rest()
    return graph.classes()


def op6_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, least(node, min(seen)) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""

"""Document fingerprints: Order MinHash over word k-mers.

A k-mer is ``KMER`` consecutive words (the whole sequence if the text has fewer); repeats of a k-mer are numbered
by occurrence, so that a text is a set of points, each the hash of k-mer and occurrence. Each sample selects the ``PICK`` points
that are minimal for it; these are put back in the order that they have in the text, and the tuple is hashed. Two texts agree in a sample only if the same
k-mers are minimal and stand in the same order, so agreement falls with edit distance, moves of passages included.

The samples' orders of points come in rounds, as in fast similarity sketching: round r hashes every point by a hash function
of its own, which gives it to one sample with a value. A sample's order is by round, then by value; points that no round
has given it come last, by the sample's own hash function. So the samples are as independent as if each had hashed every
point, but a text of a thousand points or more needs one round, and shorter ones ``ENTRIES`` hashes, not one for each point and sample.
Rounds that a text doesn't need change nothing: texts of any lengths are comparable. (A sample has fewer than PICK of ENTRIES
hashes with a probability of 2e-6; then, and in texts of under ten k-mers, its own hash function fills it.)

``likeness`` is 0 to 1: with p the share of samples that agree, j = p^(1/PICK) estimates the k-mers' Jaccard
similarity, and 2j / (1 + j) the share of k-mers that the texts have in common.

Everything is array functions inside a projection; the one shuffle puts each document beside the next by id.

Defined cases: null and blank texts count as empty and share one fingerprint, so their likeness is 1 to each other
and 0 to others; texts with equal words have equal fingerprints; rows that repeat an id are ordered by their text's
hash; null ids come last; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table

KMER = 5
PICK = 2
SAMPLES = 64

#: Hashes of a text's points at least, and rounds at most.
ENTRIES = 1024
ROUNDS = 127

#: Rows that one task orders, on average, until MAX_RANGES ranges of ids are in use.
RANGE_ROWS = 2048
MAX_RANGES = 1024

_POINT = 1 << 31
_LOW = 0xFFFFFFFF

# An entry is one number: sample, round, value and index of the point from the highest bits on.
_INDEX, _VALUE, _ROUND = 26, 24, 7


def _packed(high: Column, low: Column) -> Column:
    """Two numbers under 2^31 and 2^32 in one bigint, ordered by the first."""
    return F.shiftleft(high, 32).bitwiseOR(low)


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _each_index(n: Column, body) -> Column:
    """body(0), ..., body(n - 1); n may be 0."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), body)


def kmer_hashes(text: Column, k: int = KMER) -> Column:
    """A 31-bit hash for each k-mer of the text's words, in order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        full = _each_index(n - (k - 1), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        whole = F.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.when(n >= k, full).otherwise(whole), lambda x: x.bitwiseAND(F.lit(_POINT - 1)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def numbered(hashes: Column) -> Column:
    """The k-mers' (point of k-mer and occurrence, position), in the order of the k-mers' hashes."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        firsts = F.filter(_each_index(n, lambda i: i), lambda i: (i == 0) | (_high(F.get(s, i)) != _high(F.get(s, i - 1))))

        def points(f: Column) -> Column:
            once = F.transform(s, lambda x: _packed(F.xxhash64(_high(x), F.lit(0)).bitwiseAND(F.lit(_POINT - 1)), _low(x)))

            def run(start: Column, at: Column) -> Column:
                end = F.coalesce(F.get(f, at + 1), n)
                return _each_index(end - start, lambda o: _packed(F.xxhash64(_high(F.get(s, start + o)), o).bitwiseAND(F.lit(_POINT - 1)), _low(F.get(s, start + o))))

            return F.when(F.size(f) == n, once).otherwise(F.flatten(F.transform(f, run)))

        return _let(firsts, points)

    return _let(F.sort_array(F.transform(hashes, lambda h, i: _packed(h, i.cast("bigint")))), of_sorted)


def entry(point: Column, turn: Column, index: Column, samples: int) -> Column:
    """What round ``turn`` makes of a point."""

    def of_hash(g: Column) -> Column:
        sample = F.shiftrightunsigned(g, 32) % samples
        value = g.bitwiseAND(F.lit((1 << _VALUE) - 1))
        return F.shiftleft(sample, _ROUND + _VALUE + _INDEX).bitwiseOR(F.shiftleft(turn.cast("bigint"), _VALUE + _INDEX)).bitwiseOR(F.shiftleft(value, _INDEX)).bitwiseOR(index.cast("bigint"))

    return _let(F.xxhash64(point, turn), of_hash)


def order_minhash(text: Column, k: int = KMER, pick: int = PICK, samples: int = SAMPLES) -> Column:
    """The fingerprint as an array of ``samples`` (64 at most) hashes of 32 bits; empty for a text without words."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda j: F.shiftleft(j.cast("bigint"), _ROUND + _VALUE + _INDEX))
    index_of = lambda e: (e.bitwiseAND(F.lit((1 << _INDEX) - 1)) - 1).cast("int")

    def of_points(u: Column) -> Column:
        n = F.size(u)
        rounds = F.least(F.lit(ROUNDS), F.ceil(F.lit(ENTRIES) / n)).cast("int")
        # Indices from 1 on, so that no entry is a mark. Marks sorted among the entries tell where a sample's begin.
        entries = F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), lambda r: F.transform(u, lambda x, i: entry(_high(x), r, i + 1, samples))))
        return F.when(n > 0, _let(F.sort_array(F.concat(entries, marks)), lambda merged: of_merged(u, merged))).otherwise(F.array().cast("array<bigint>"))

    def of_merged(u: Column, merged: Column) -> Column:
        places = F.filter(F.transform(merged, lambda x, i: F.when(x.bitwiseAND(F.lit((1 << (_ROUND + _VALUE + _INDEX)) - 1)) == 0, i)), lambda i: i.isNotNull())
        return _let(places, lambda places: F.transform(places, lambda place, j: sample(u, merged, place, F.coalesce(F.get(places, j + 1), F.size(merged)), j)))

    def sample(u: Column, merged: Column, place: Column, end: Column, j: Column) -> Column:
        some = lambda size: F.array_distinct(F.transform(F.slice(merged, place + 2, size), index_of))
        held = end - place - 1
        few, wanted = some(F.least(held, F.lit(4 * pick))), F.least(F.lit(pick), F.size(u))
        given = _let(few, lambda f: F.when(F.size(f) >= wanted, f).otherwise(_let(some(held), lambda m: F.when(F.size(m) >= wanted, m).otherwise(F.array_distinct(F.concat(m, by_own(u, j)))))))
        picked = F.transform(F.slice(given, F.lit(1), wanted), lambda i: F.get(u, i))
        in_order = F.sort_array(F.transform(picked, lambda x: _packed(_low(x), _high(x))))
        return F.xxhash64(F.transform(in_order, _low)).bitwiseAND(F.lit(_LOW))

    def by_own(u: Column, j: Column) -> Column:
        """All indices by the sample's own hash function."""
        own = F.sort_array(F.transform(u, lambda x, i: F.struct(F.xxhash64(_high(x), F.lit("own"), j).alias("h"), i.alias("i"))))
        return F.transform(own, lambda x: x["i"])

    return _let(numbered(kmer_hashes(text, k)), of_points)


def likeness(a: Column, b: Column, pick: int = PICK) -> Column:
    """0 to 1; see the module's text."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    j = F.pow(same / F.greatest(F.size(a), F.size(b)), F.lit(1.0 / pick))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2 * j / (1 + j))


def as_text(fingerprint: Column) -> Column:
    """The fingerprint as lowercase hex, eight digits a sample."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def beside_next(docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Every row with ``values``, and with each as next_<name> of the next row by descending id (after the last: of the first).

    Ids are cut into ranges at values that occur; a range is one window. The rows at a range's upper end are also
    copied to the range above, behind its last row, so no row's neighbour is in another window.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.select(key.alias("id_key")).agg(F.count("*").alias("n")).first()["n"]
    ranges = min(MAX_RANGES, max(1, rows // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx(key, [1 - i / ranges for i in range(ranges)], 10_000).alias("cuts"), F.max(key).alias("top")).first()
    # The upper ends of the ranges, falling; the first is the largest id.
    tops = sorted({*(cuts["cuts"] or []), cuts["top"] if cuts["top"] is not None else 0}, reverse=True)
    ends = F.array(*map(F.lit, tops)).cast("array<bigint>")
    at = F.size(F.filter(ends, lambda e: e >= F.col("id_key"))) - 1
    laid = docs.select("doc_id", key.alias("id_key"), *(v.alias(n) for n, v in values.items())).withColumn("range", at)
    is_end = F.array_contains(ends, F.col("id_key"))
    ghost = F.when(F.col("range") == 0, F.lit(len(tops) - 1)).otherwise(F.col("range") - 1)
    placed = F.array(F.struct(F.lit(False).alias("ghost"), F.col("range").alias("window")))
    both = F.concat(placed, F.array(F.struct(F.lit(True).alias("ghost"), ghost.alias("window"))))
    dealt = laid.withColumn("p", F.explode(F.when(is_end, both).otherwise(placed))).select("doc_id", "id_key", *values, "p.*")
    order = Window.partitionBy("window").orderBy("ghost", F.col("id_key").desc(), *(F.col(n) for n in ("text_hash",) if n in values))
    return dealt.select("*", *(F.lead(n).over(order).alias(f"next_{n}") for n in values)).where("not ghost").select("doc_id", *values, *(f"next_{n}" for n in values))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and text to the fingerprints of the text and of its edited form, and their likeness; see ``op3``'s contract."""
    text = F.coalesce("text", F.lit(""))
    pairs = beside_next(docs.select("doc_id", "text"), {"text": text, "text_hash": F.xxhash64(text), "print": order_minhash(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    told = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    told = told.withColumn("edited_print", order_minhash(F.col("edited")))
    return told.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))

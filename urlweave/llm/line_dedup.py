"""Line dedup by winnowing.

The unit is a line; a line long enough to hold a passage inside falls into units after those sentence ends whose next
letter isn't N to Z, which is a rule of the content alone, so a passage is cut alike wherever it stands. Units without
words are left out of all that follows and stay. A gram is the shortest run of units from some unit on
that holds at least ``GRAM_WORDS`` words; a window is the shortest run that holds at least ``RUN_WORDS``. In every window
the gram of least hash (the last of equals) is selected: so a run of RUN_WORDS or more words in whole units that two places
share has a gram selected in both, and what is shorter stays. Selected grams, and the whole
windows beside them, are joined to their first place, documents in order of id: the first place of a frequent gram may be
followed by other lines, that of a window is followed by the window's own. Where a document repeats itself, only its first
place of a fingerprint meets another document; each further one meets the place before it in the document, so that
lines that repeat with one period are one match, however many they are. Each match is extended both ways, unit by unit, while the units agree,
and if they hold RUN_WORDS words the units of the later place are deleted, a line's break with its last unit. A unit that goes always has an equal one at an earlier place, so
the first copy of every unit stays, and every unit of a window that an earlier place has goes. Of a passage
inside a line, the pieces before its first and behind its last cut stay.

Work is on arrays of unit hashes, some bytes for a unit; texts are shuffled once, to lose their units. A gram that a
third of all documents share meets its first place in a join whose hot key adaptive execution splits; grams are
never paired with each other.

Defined cases: a null text stays null and an empty one empty; words are counted by the blanks between them, white space of other kinds
inside a unit being part of it;
a document of fewer than RUN_WORDS words loses nothing; rows that repeat both id and text are one document
and are cleaned alike; of rows with one id, the order is by text hash; null ids come first; an empty table gives
an empty table; the columns of the input stay whatever their names, with ``text`` cleaned and ``n_chars`` brought up to
date; columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, stage, table

GRAM_WORDS = 12
RUN_WORDS = 25

#: Lines of up to so many bytes are one unit: shorter ones can't hold two windows.
WHOLE_BYTES = 4 * RUN_WORDS

#: Where longer lines are cut: a rule of what stands around the place.
CUT = r"(?<=[.!?] )(?![N-Zn-z ])"

#: White space around a unit that isn't part of it.
AROUND = " \t\x0b\x0c\r"

#: Words of the bitmap of repeated fingerprints at most (64 bits each); a broadcast of 16 bytes for each. More fingerprints only
#: let more others through to the exact join.
BITMAP_WORDS = 1 << 20


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def units_of(line: Column) -> Column:
    """The line's units, in order; together they are the line."""
    return F.when(F.octet_length(line) > WHOLE_BYTES, F.split(line, CUT)).otherwise(F.array(line))


def place(line: Column, unit: Column) -> Column:
    """A unit's place: ordered, and one number for line and unit."""
    return F.shiftleft(line.cast("bigint"), 32).bitwiseOR(unit.cast("bigint"))


def _worded(lines: Column) -> Column:
    """(hash, words, place) of the units that hold words."""

    def told(bare: Column, at: Column) -> Column:
        words = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
        return F.struct(F.xxhash64(bare).alias("h"), F.when(bare == "", F.lit(0)).otherwise(words).alias("w"), at.alias("line"))

    bare = lambda u: F.btrim(u, F.lit(AROUND))
    each = F.transform(lines, lambda x, i: F.transform(units_of(x), lambda u, k: _let(bare(u), lambda t: told(t, place(i, k)))))
    return F.filter(F.flatten(each), lambda x: x["w"] > 0)


def without(lines: Column, gone: Column) -> Column:
    """The text less the units at the places ``gone``; a line all of whose units go, goes with its break."""

    def of_units(units: Column) -> Column:
        every = F.flatten(F.transform(units, lambda us, i: F.transform(us, lambda u, k: place(i, k))))
        return _let(F.array_except(every, gone), lambda kept: joined(units, kept))

    def joined(units: Column, kept: Column) -> Column:
        line = lambda p: F.shiftright(p, 32).cast("int")
        breaks = lambda p, n: F.when((n > 0) & (line(p) != line(F.get(kept, n - 1))), F.lit("\n")).otherwise(F.lit(""))
        return F.array_join(F.transform(kept, lambda p, n: F.concat(breaks(p, n), F.get(F.get(units, line(p)), p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))), "")

    return _let(F.transform(lines, units_of), of_units)


def line_table(docs: DataFrame) -> DataFrame:
    """A staged row for each document: doc_id, text_hash and the arrays h, w, line (place) of its units with words."""
    told = docs.where("text is not null").select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), _worded(F.split("text", "\n")).alias("l"))
    # No condition on l here: it would pass below and cut every text once more.
    arrays = told.select("doc_id", "text_hash", *(F.col(f"l.{c}").alias(c) for c in ("h", "w", "line")))
    # Equal (id, text hash) are one document: the first stands for all.
    return stage(arrays.groupBy("doc_id", "text_hash").agg(*(F.first(c).alias(c) for c in ("h", "w", "line"))), "lines")


def selected_grams(lines: DataFrame) -> DataFrame:
    """The fingerprints: doc_id, text_hash, at (index among the units with words), gram (or a whole window's hash), and the document's last place of it before, if any."""
    # Documents are dealt out before they fall into rows, so nothing below is shuffled.
    dealt = lines.select("doc_id", "text_hash", "h", "w").repartition("doc_id", "text_hash")
    each = dealt.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("h", "w")).alias("at", "l")).select("doc_id", "text_hash", "at", "l.*")
    doc = Window.partitionBy("doc_id", "text_hash")
    begin = F.coalesce(F.sum("w").over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("begin", begin.cast("bigint"))
    # By words: the units that begin less than so many words after this one, and so reach that many unless the text ends.
    of_gram = doc.orderBy("begin").rangeBetween(0, GRAM_WORDS - 1)
    of_run = doc.orderBy("begin").rangeBetween(0, RUN_WORDS - 1)
    end = F.max(F.col("begin") + F.col("w"))
    each = each.withColumns({"gram": F.xxhash64(F.collect_list("h").over(of_gram)), "gram_end": end.over(of_gram)})
    full = F.when(F.col("gram_end") - F.col("begin") >= GRAM_WORDS, F.struct("gram", (-F.col("at")).alias("back"), "gram_end"))
    each = each.withColumns({"grams": F.collect_list(full).over(of_run), "run": F.xxhash64(F.collect_list("h").over(of_run)), "run_end": end.over(of_run)})
    window = each.where(F.col("run_end") - F.col("begin") >= RUN_WORDS)
    least = F.array_min(F.filter("grams", lambda g: g["gram_end"] <= F.col("run_end")))
    both = F.array(F.struct((-F.col("g.back")).alias("at"), F.col("g.gram").alias("gram")), F.struct("at", F.col("run").alias("gram")))
    chosen = window.withColumn("g", least).select("doc_id", "text_hash", F.inline(both))
    again = Window.partitionBy("doc_id", "text_hash", "gram").orderBy("at")
    # What several windows select follows itself.
    return chosen.withColumn("before", F.lag("at").over(again)).where("before is null or before < at")


def _spot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(64 * BITMAP_WORDS))


def repeated(grams: DataFrame) -> DataFrame:
    """The documents' first places of fingerprints that an earlier document has, with the first of all as f."""
    own = grams.where("before is null").drop("before")
    firsts = own.groupBy("gram").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = stage(firsts.select("gram", "f"), "firsts")
    # Most fingerprints have one place: a bitmap keeps them from the join's shuffle.
    bits = firsts.select(_spot(F.col("gram")).alias("spot")).groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
    maybe = own.withColumn("spot", _spot(F.col("gram"))).join(F.broadcast(bits), F.expr("spot div 64") == F.col("word")).where("getbit(bits, cast(spot % 64 as int)) = 1").drop("spot", "word", "bits")
    here = F.struct("doc_id", "text_hash", "at")
    return maybe.join(firsts, "gram").where(~here.eqNullSafe(F.col("f")))


def deleted_lines(lines: DataFrame) -> DataFrame:
    """doc_id, text_hash and the sorted places that go."""
    grams = stage(selected_grams(lines), "grams")
    inside = grams.where("before is not null").withColumn("f", F.struct("doc_id", "text_hash", F.col("before").alias("at"))).drop("before")
    later = repeated(grams).unionByName(inside)
    # Matches of one document with one earlier place lie on diagonals: one row for each, with the matched indices.
    diagonals = later.groupBy("doc_id", "text_hash", F.col("f.doc_id").alias("doc_0"), F.col("f.text_hash").alias("hash_0"), (F.col("at") - F.col("f.at")).alias("shift")).agg(F.array_sort(F.collect_set("at")).alias("hits"))
    other = lines.select(F.col("doc_id").alias("id_0"), F.col("text_hash").alias("th_0"), F.col("h").alias("h0"))
    mine = lines.select(F.col("doc_id").alias("id_1"), F.col("text_hash").alias("th_1"), "h", "w", "line")
    sided = diagonals.join(other, F.col("doc_0").eqNullSafe(F.col("id_0")) & (F.col("hash_0") == F.col("th_0"))).drop("id_0", "th_0")
    sided = sided.join(mine, F.col("doc_id").eqNullSafe(F.col("id_1")) & (F.col("text_hash") == F.col("th_1")))
    n = F.size("h")
    # Where the two sides part, with the ends: a match extends from the last break before it to the next.
    apart = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("h", i).eqNullSafe(F.when(i >= F.col("shift"), F.get("h0", i - F.col("shift")))))
    breaks = sided.withColumn("breaks", F.concat(F.array(F.lit(-1)), apart, F.array(n)))
    runs = F.filter(F.transform("breaks", lambda b, k: F.struct((b + 1).alias("low"), (F.get("breaks", k + 1) - 1).alias("high"))), lambda r: r["high"].isNotNull() & (r["high"] >= r["low"]))
    long = lambda r: F.aggregate(F.slice("w", r["low"] + 1, r["high"] - r["low"] + 1), F.lit(0), lambda n, w: n + w) >= RUN_WORDS
    matched = F.filter(runs, lambda r: F.exists("hits", lambda x: (x >= r["low"]) & (x <= r["high"])) & long(r))
    gone = F.flatten(F.transform(matched, lambda r: F.slice("line", r["low"] + 1, r["high"] - r["low"] + 1)))
    return breaks.select("doc_id", "text_hash", gone.alias("gone")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the cleaned text, and n_lines and n_removed (units); lines end at a line feed."""
    gone_id, gone_hash, hash_, gone_at = (fresh(docs, x) for x in ("_gone_id", "_gone_hash", "_text_hash", "_gone"))
    gone = deleted_lines(line_table(docs)).toDF(gone_id, gone_hash, gone_at)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    joined = docs.select(*map(quoted, kept), F.xxhash64("text").alias(hash_)).join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(hash_) == F.col(gone_hash)), "left")
    lines = F.split("text", "\n")
    left = without(lines, F.col(gone_at))
    removed = F.coalesce(F.size(gone_at), F.lit(0))
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(left)
    told = joined.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"), "n_removed": F.when(F.col(gone_at).isNull(), F.lit(0)).otherwise(removed).cast("bigint"), "text": text})
    if "n_chars" in kept:
        told = told.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return told.select(*map(quoted, kept), "n_lines", "n_removed")


def op4_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the runs of units that an earlier place has, its lines and the units that went."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")

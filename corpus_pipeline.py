"""A training corpus from ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``. ``run`` writes what a stage returns to the shared folder before the next one reads it.

Rows that a stage drops: those that the quality classifier rejects; those whose words all went as repeated lines; all
but one row of each near-duplicate class (of smallest id, null ids last, then text hash; of rows without words, those that
repeat id and text); those that
the mixture takes no words of. Null texts count as empty throughout; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlweave.llm.bpe import default_vocabulary, tokenise
from urlweave.llm.common import WORD, fresh, quoted, ship, stage, table
from urlweave.llm.line_dedup import dedup_lines
from urlweave.llm.mixture import mix_documents
from urlweave.llm.near_dedup import near_duplicates
from urlweave.llm.quality_crf import in_training, score_quality, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels' training part, does not reject."""
    ship(spark)
    field = train(docs, table(spark, sf_dir, "labels").where(in_training()))
    score = fresh(docs, "score")
    return score_quality(docs, field, score).where(F.col(score) >= 0.5).select(*map(quoted, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier document has."""
    cleaned = dedup_lines(docs)
    return cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).select(*map(quoted, docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, whatever the ids."""
    row = fresh(docs, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "near_rows")
    classes = near_duplicates(rows, row).select(F.col("doc_id").alias("of_row"), "n_shingles", "component_id")
    told = rows.select(F.col(row).alias("of_row"), "doc_id", F.xxhash64("text").alias("text_hash")).join(classes, "of_row")
    worded = F.col("n_shingles") > 0
    keys = [F.when(worded, F.col("component_id")).alias("of_words"), F.when(~worded, F.struct("doc_id", "text_hash")).alias("of_text")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "of_row"))
    kept = told.groupBy(*keys).agg(first.alias("first")).select(F.col("first.of_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*map(quoted, docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix to target weights takes them, copies included."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether they decode to the text."""
    path, pattern = default_vocabulary()
    return tokenise(docs.select("doc_id", "lang", "source", "n_chars", "text"), path, pattern)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixture", mixture), ("byte_bpe", tokens)]

#: SQL can't express the classifier or the mixture's draws; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage_{name}")
    return docs

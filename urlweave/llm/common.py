"""What the operators share: the scratch folder, staged tables and text expressions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["SPACE", "WORD", "crc_mod", "fresh", "lean", "lower_ascii", "pieces", "quoted", "relieve", "scratch_dir", "ship", "stage", "table", "with_arrow"]

#: The white space of the contracts, as a regular expression class, and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Where scratch tables go if the session names no folder; for local masters only.
LOCAL_SCRATCH = "/tmp/checkpoints/urlweave"


#: Of the driver's largest heap: what it may take before a staged table makes it give back what it doesn't use.
HEAP_SHARE = 0.5


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Without the setting, a local folder serves a local master; elsewhere that would put files on one
    machine only, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def relieve(spark: SparkSession) -> None:
    """The driver's JVM gives back what planning ended jobs took, if its heap has grown past HEAP_SHARE of its limit.

    A chain of staged jobs leaves little alive but lets the heap grow to its limit.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        runtime.gc()


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, col: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows that hold about ``limit`` bytes of a string, binary or list column; one row may have more."""
    at, values = 0, batch.column(col)
    if not len(values):
        return
    size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    before = np.concatenate([[0], np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(before, before[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def lean(run):
    """``run`` over a task's batches; the worker, which outlives the task, then gives what it no longer holds back to the system."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return freed


def with_arrow(df: DataFrame, run, new: str, without: str | None = None) -> DataFrame:
    """``df``, less the column ``without``, with the columns of the schema ``new`` that ``run`` adds behind a batch's own.

    Columns go by number meanwhile, so any name will do.
    """
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    kept = [k for k, c in enumerate(df.columns) if c != without]
    old = ", ".join(f"c{k} {df.schema[k].dataType.simpleString()}" for k in kept)
    made = numbered.mapInArrow(lean(run), ", ".join(x for x in (old, new) if x))
    return made.toDF(*(df.columns[k] for k in kept), *(x.split()[0] for x in new.split(", ")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))

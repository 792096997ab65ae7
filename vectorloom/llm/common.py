"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.sources.shared import shared_dir

#: The blanks that separate words: space and the control characters 9 to 13, as in `bytes.split()`.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that a task hands to Python, and of a batch in which Parquet is read.
BATCH = 1000
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns can have any name; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: this cuts the lineage, survives lost executors and gives Spark the true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, batches have at most BATCH rows, for long texts make those of the default length large; then the session's settings are as before."""
    before = {k: v for k in BATCHES if not 0 < int(v := spark.conf.get(k)) <= BATCH}
    for k in before:
        spark.conf.set(k, str(BATCH))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once nothing that is still to run reads them: what was made of them has been written
    itself. Spark deletes shuffle files when the driver's garbage is collected, so that is asked for too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        spark._jvm.System.gc()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def some(batches: Iterable[pa.RecordBatch], rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows. Spark bounds a batch by its bytes; this bounds what a task makes of one in Python."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()  # a worker goes on with other tasks


def give_back() -> None:
    """Return to the system what this process has freed: Arrow and the C library keep it otherwise, and a worker lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key beyond which its rows are not dealt to one task; and rows, of some dozen bytes, that may be broadcast.
HOT, SMALL = 100_000, 500_000


def join_hot(rows: DataFrame, of: DataFrame, key: str, n: str = "n") -> DataFrame:
    """`rows` joined with `of` by `key`, where `of` has a row for each key and in `n` the number of its rows.

    Keys of more than HOT rows, of which there can't be many, are broadcast after they were counted; the others are
    shuffled. No task gets all rows of a hot key.
    """
    hot = materialize(of.where(F.col(n) > HOT), "hot")
    if not 0 < hot.count() <= SMALL:
        return rows.join(of, key)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(key), key, "left_anti").join(of.where(F.col(n) <= HOT), key)
    return cold.unionByName(rows.join(hot, key))


def keep_ids(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id isn't in `lost` (doc_id); rows of a null id stay, and all columns."""
    lost = materialize(lost.select(F.col("doc_id").alias("__lost")).where("__lost is not null").distinct(), "lost")
    lost = F.broadcast(lost) if lost.count() <= SMALL else lost.hint("shuffle_hash")
    return docs.join(lost, docs["doc_id"] == lost["__lost"], "left_anti")

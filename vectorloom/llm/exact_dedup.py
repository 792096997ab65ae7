"""Exact dedup against immutable snapshots, screened by static binary fuse filters.

A snapshot holds one row for each digest, in buckets by the digest's first bits, and one filter a bucket. An incoming
batch is first grouped by digest on its own; its distinct digests are screened by their bucket's filter, and only
positives join the snapshot's exact rows. Digests with more than one row get a byte check: their rows are grouped again
by digest and whole normalised text, so texts that merely share a digest stay apart. Copies collapse in the tasks that
read them, before any shuffle, however large their group.

Defined results: a null text is empty; a null doc_id is never the least of a group that has another; rows that repeat
the least doc_id of their group all stay; very long texts are compared whole; an empty table, snapshot or batch gives the
result of the other alone; other columns, whatever their names, are left out of `duplicates` and kept by `exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import BLANK, fold, join_hot, keep_ids, materialize, partitions, table, texts

#: Digests a bucket, about: what bounds a filter and the rows from which one is built.
BUCKET = 1 << 16
#: Digests that may be broadcast, 32 bytes each; more are joined by a shuffle.
SMALL = 200_000
#: Of the registered query, the snapshot has the documents whose crc32 of the id leaves no remainder by this.
HALVES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))


def _key(digests: pa.Array) -> np.ndarray:
    """The digests' first eight bytes; shorter digests are padded."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests.to_pylist()), "<u8").astype(np.uint64)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) for the distinct digests of a snapshot; a bucket's keys, about BUCKET, are all that a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([fuse.build(np.concatenate(held))], pa.binary())], ["bucket", "filter"])

        for b in batches:
            ids, keys = b["bucket"].to_numpy(zero_copy_only=False), _key(b["digest"])
            for at in np.split(np.arange(len(ids)), np.nonzero(np.diff(ids))[0] + 1):
                if not len(at):
                    continue
                if held and ids[at[0]] != now:
                    yield flush()
                    held = []
                now = int(ids[at[0]])
                held.append(keys[at])
        if held:
            yield flush()

    rows = snapshot.select(_bucket(buckets).alias("bucket"), "digest")
    return rows.repartition(partitions(snapshot.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest) of the distinct incoming digests that their bucket's filter may hold; filter and digests meet by bucket, nothing is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blob = None, None
        for b in batches:
            ids, filters = b["bucket"].to_numpy(zero_copy_only=False), b["filter"]
            for at in np.split(np.arange(len(ids)), np.nonzero(np.diff(ids))[0] + 1):
                if not len(at):
                    continue
                if ids[at[0]] != now:
                    now, blob = ids[at[0]], None
                if filters[int(at[0])].is_valid:  # the bucket's first row
                    blob, at = filters[int(at[0])].as_py(), at[1:]
                if blob is not None and len(at):
                    digests = b["digest"].slice(int(at[0]), len(at))
                    yield pa.RecordBatch.from_arrays([digests.filter(pa.array(fuse.maybe_in(blob, _key(digests))))], ["digest"])

    no = F.lit(None).cast("binary")
    both = filters.select("bucket", "filter", no.alias("digest")).union(incoming.select(_bucket(buckets).alias("bucket"), no.alias("filter"), "digest"))
    dealt = both.repartition(partitions(incoming.sparkSession), "bucket").sortWithinPartitions("bucket", F.col("filter").isNull())
    return dealt.mapInArrow(run, "digest binary")


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def duplicates(snapshot: DataFrame, incoming: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each row of both tables, (doc_id, text) each.

    `digest` is a parameter so that tests can make texts collide.
    """
    both = texts(snapshot).withColumn("old", F.lit(True)).union(texts(incoming).withColumn("old", F.lit(False)))
    norm = both.withColumn("norm", normalised(F.col("text")))
    rows = materialize(norm.select("doc_id", "old", digest(F.col("norm")).alias("digest")), "digests")

    old, new = materialize(_grouped(rows.where("old")), "snapshot"), materialize(_grouped(rows.where("not old")), "batch")
    buckets = max(1, -(-old.count() // BUCKET))
    positive = screen(new, materialize(snapshot_filters(old, buckets), "filters"), buckets)
    met = positive.join(old.select("digest"), "digest")
    # whatever has copies: in the snapshot, within the batch, or across
    several = old.where("copies > 1").select("digest").union(new.where("copies > 1").select("digest")).union(met).distinct()
    several = materialize(several, "several")

    small = _near(several, several.count())
    checked = norm.withColumn("digest", digest(F.col("norm"))).join(small, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    proof = F.struct(F.sha2("norm", 256), F.xxhash64("norm"), F.length("norm")).alias("proof")
    checked = materialize(checked.select("digest", "keep_id", "group_size", proof), "groups")
    shared = checked.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    single = checked.join(shared, "digest", "left_anti")
    # rows without copies need no join; those of a digest with very many are not dealt to one task
    lone = rows.join(small, "digest", "left_anti").select("digest", "doc_id", "old", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    group = lone.unionByName(join_hot(rows.join(small, "digest", "left_semi"), single.select("digest", "keep_id", "group_size"), "digest", "group_size"))
    if shared.isEmpty():
        out = group
    else:  # texts that share a digest: their rows take the group of their own text
        apart = norm.withColumn("digest", digest(F.col("norm"))).join(F.broadcast(shared.select("digest")) if shared.count() <= SMALL else shared.select("digest"), "digest", "left_semi")
        apart = apart.select("digest", "doc_id", "old", proof).join(checked, ["digest", "proof"]).select("digest", "doc_id", "old", "keep_id", "group_size")
        out = group.unionByName(apart)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")


def _halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = F.coalesce(fold("doc_id", HALVES) == 0, F.lit(False))
    return docs.where(old), docs.where(~old)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all columns: of equal texts the least doc_id."""
    return keep_ids(docs, duplicates(*_halves(docs)).where("not kept").select("doc_id"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicates(*_halves(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

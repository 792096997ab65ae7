"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's part of the words to take; no source gives more than `epochs` times its words, and what
the full sources leave is shared again by weight until none is above. A document is taken as often as the whole part of
its source's rate says; for the fractional part a seeded order of the source's documents is taken up to the words that
are missing, the document on the border in part. All choices compare a row with one bounded row for each source, so a
hot source is never gathered or sorted: only the rows of one of its 65,536 hash buckets are.

Defined results: a null text has no words; a null source is a source of its own, after all others; repeated rows share
what is taken from them evenly; rows that tie in the seeded order are ordered by id, size and text; a source without
words gives target 0; very long texts are counted whole; an empty table gives an empty result; columns beyond the four
that are read, whatever their names, are kept by `mix` and left out by the query.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, materialize, partitions, table

WEIGHTS, SHARE, EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 7
KEY = ["h", "id", "size", "t"]
#: Hexadecimal digits of h.
HEX = 15


def word_count(text: Column) -> Column:
    """The number of words, without making them rows."""
    text = F.coalesce(text, F.lit(""))
    edge = lambda c: c.rlike(f"^{BLANK}").cast("long")
    pieces = F.size(F.split(text, BLANK, -1)).cast("long") - edge(F.substring(text, 1, 1)) - edge(F.right(text, F.lit(1)))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(pieces)


def _key_columns(seed: int) -> list[Column]:
    """A row's source, words and place in the seeded order: (h, id, size, t), which only equal rows share. Both digests are md5, which every engine has."""
    t = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), t).cast("binary"))
    h = F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long")
    return [F.col("source").alias("src"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("size"), h.alias("h"), t.alias("t")]


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(*_key_columns(seed))


def ranked(sources: DataFrame) -> DataFrame:
    """Add `rank`, from 0, in the code point order of `src`, null last, without one task that sorts all sources."""
    order = F.col("src").asc_nulls_last()
    n = partitions(sources.sparkSession)
    parts = materialize(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return parts.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).drop("part", "n", "before")


def water_level(sources: DataFrame, words: float) -> float:
    """The level at which least(cap, level * w) sums to `words`, or infinity if the caps don't reach it. Each round is one aggregate of the sources."""
    level, full = 0.0, -1
    while True:
        above = F.col("cap") < F.col("w") * level
        capped, weight, n = sources.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)), F.count(F.when(above, 1))).first()
        if weight == 0:
            return float("inf")
        if n == full:
            return level
        level, full = (words - capped) / weight, n


def source_plan(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """One row a source: source_size, target, whole (repetitions of each document) and the border document's key, `part` and `ties`."""
    sums = keyed.groupBy("src").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = materialize(ranked(sums).select("src", "source_size", w.alias("w"), (F.col("source_size") * epochs).cast("double").alias("cap")), "weights")
    total = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(src, share * total)
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.col("w") * F.lit(level))
    src = src.withColumn("target", target).withColumn("words", F.round("target").cast("long"))
    src = src.withColumn("whole", F.coalesce(F.expr("try_divide(words, source_size)"), F.lit(0)).cast("long")).withColumn("need", F.col("words") - F.col("whole") * F.col("source_size"))

    same = lambda a, b: a["src"].eqNullSafe(b["src"])
    upto = lambda *order: Window.partitionBy("src").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the order of buckets is that of their rows; the border's bucket is found among 256, and then among 256 of that one
    rows, left = keyed, src.where("need > 0").select("src", F.col("need").alias("left"))
    for shift in (4 * HEX - 8, 4 * HEX - 16):
        cum = rows.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto("bucket")))
        cut = cum.join(left, same(cum, left)).where("upto - n <= left and left < upto").select(cum["src"], "bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))
        cut = materialize(cut, "cut")
        rows = keyed.join(cut, same(keyed, cut) & (F.shiftright(keyed["h"], shift) == cut["bucket"])).select(keyed["*"], "left")
        left, rows = cut.select("src", "left"), rows if shift == 4 * HEX - 16 else rows.drop("left")
    equal = rows.groupBy("src", *KEY, "left").agg(F.count("*").alias("ties")).withColumn("upto", F.sum(F.col("size") * F.col("ties")).over(upto(*KEY)))
    border = equal.where("upto - size * ties <= left and left < upto").select("src", *[F.col(k).alias(f"b_{k}") for k in KEY], F.floor((F.col("left") - F.col("upto") + F.col("size") * F.col("ties")) / F.col("ties")).alias("part"))
    return materialize(src.join(border, same(src, border), "left").select(src["src"].alias("p_src"), "source_size", "target", "whole", *[f"b_{k}" for k in KEY], "part"), "plan")


def _copies() -> tuple[Column, Column]:
    """Whole copies of a row, and the words of it that are taken besides."""
    mine, theirs = F.struct(*[F.col(k) for k in KEY]), F.struct(*[F.col(f"b_{k}").alias(k) for k in KEY])
    has = F.col("part").isNotNull()
    copies = F.col("whole") + F.when(has & (mine < theirs), 1).otherwise(0)
    return copies, F.when(has & mine.eqNullSafe(theirs), F.col("part")).otherwise(F.lit(0).cast("long"))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of `docs`: the words that the mix takes of it, repetitions counted."""
    keyed = materialize(_keyed(docs, seed), "sizes")
    plan = source_plan(keyed, weights, share, epochs)
    copies, part = _copies()
    return keyed.join(plan, keyed["src"].eqNullSafe(plan["p_src"])).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size") + part).cast("long").alias("taken"))


@F.pandas_udf(T.StringType())
def _first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    def cut(t: str, k: int) -> str:
        b = t.encode()
        pieces = b.split(None, k)
        return (b[: len(b) - len(pieces[k])] if len(pieces) > k else b).rstrip().decode()

    return pd.Series([cut(t or "", int(k)) for t, k in zip(text, n, strict=True)])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of `docs`: whole rows as often as they are taken, and the first words of each source's border document."""
    plan = source_plan(materialize(_keyed(docs, seed), "sizes"), weights, share, epochs)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_key_columns(seed))
    copies, part = _copies()
    met = row.join(plan, row["src"].eqNullSafe(plan["p_src"])).select("row", copies.cast("int").alias("copies"), part.alias("taken"))
    full = met.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    some = met.where("taken > 0").select(F.col("row").withField("text", _first_words("row.text", "taken")).alias("row")).select("row.*")
    return full.unionByName(some)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, md5(text) AS t, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, {HEX}))::BIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(rank % {len(WEIGHTS)} + 1)::INT] AS w, source_size * {EPOCHS} AS cap, {SHARE} * sum(source_size) OVER () AS words FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, rank) AS n FROM w),
l AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min(n) AS first FROM l WHERE level * w <= cap),
p AS (SELECT source, source_size, CASE WHEN n >= first THEN least(cap, (SELECT level FROM l WHERE n = (SELECT first FROM f)) * w) ELSE cap END AS target FROM l, f),
q AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM p),
r AS (SELECT *, words - whole * source_size AS need FROM q),
e AS (SELECT source, h, doc_id, size, t, count(*) AS ties FROM k GROUP BY ALL),
c AS (SELECT *, sum(size * ties) OVER (PARTITION BY source ORDER BY h, doc_id, size, t) AS upto FROM e),
g AS (SELECT c.*, r.source_size, r.target, r.whole, r.need, CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END AS more, CASE WHEN need > 0 AND upto - size * ties <= need AND need < upto THEN (need - upto + size * ties) // ties ELSE 0 END AS part FROM c JOIN r ON r.source IS NOT DISTINCT FROM c.source)
SELECT k.doc_id, k.size::BIGINT AS size, g.source_size, g.target, ((g.whole + g.more) * k.size + g.part)::BIGINT AS taken FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source AND k.h = g.h AND k.doc_id IS NOT DISTINCT FROM g.doc_id AND k.size = g.size AND k.t = g.t
"""

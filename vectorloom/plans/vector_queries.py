"""V: validation, distances, storage and quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import search
from vectorloom.operators import vectors as ops

from .registry import query, table
from .sql import UNITS, dot, norm

DIM = 64
#: Embeddings with rows that break the contract: every 50th is zero, every 50th after that has 63 places.
BROKEN = """broken AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN vec_id % 50 = 1 THEN embedding[1:63] ELSE embedding END AS embedding FROM embeddings)"""
PAIRS = "pairs AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
Q8 = """lim AS (SELECT i, min(x) AS lo, CASE WHEN max(x) - min(x) < 1e-8 THEN min(x) + 1e-6 ELSE max(x) END AS hi FROM
  (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i),
vals AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
q AS (SELECT vec_id, i, x, lo, hi, floor(least(greatest((x - lo) / (hi - lo) * {most}, 0), {most})) AS level FROM vals JOIN lim USING (i))"""


def broken(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 0, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(F.col("vec_id") % 50 == 1, F.slice(e, 1, 63)).otherwise(e).alias("embedding"))


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query(f"WITH {BROKEN} SELECT vec_id, round({norm('embedding')}, 6) AS old_norm, 1.0 AS new_norm FROM broken WHERE len(embedding) = 64 AND {norm('embedding')} > 0")
def v1_validate_vector(spark, sf_dir):
    good, _ = ops.validated(broken(spark, sf_dir).withColumn("old", F.col("embedding")), DIM)
    return good.select("vec_id", F.round(V.norm("old"), 6).alias("old_norm"), F.round(V.norm("embedding"), 6).alias("new_norm"))


@query(f"WITH {BROKEN} SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' ELSE 'zero norm' END AS problem FROM broken WHERE len(embedding) <> 64 OR {norm('embedding')} = 0")
def v2_validate_batch(spark, sf_dir):
    return ops.validated(broken(spark, sf_dir), DIM)[1].select("vec_id", "problem")


@query(f"WITH {BROKEN} SELECT vec_id // 5 AS document_id, min(len(embedding)) AS dims, min(len(embedding)) = max(len(embedding)) AS consistent FROM broken GROUP BY 1")
def v3_document_dimensions(spark, sf_dir):
    return ops.consistent_documents(broken(spark, sf_dir).withColumn("document_id", F.floor(F.col("vec_id") / 5)))


@query(f"WITH {PAIRS} SELECT vec_id, round(1 - {dot('x', 'y')}, 6) AS distance FROM pairs")
def v4_cosine_distance(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(V.cosine_distance("x", "y"), 6).alias("distance"))


@query(f"WITH {BROKEN}, p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM broken a JOIN broken b ON b.vec_id = a.vec_id + 2 WHERE len(a.embedding) = 64 AND len(b.embedding) = 64) SELECT vec_id, CASE WHEN {norm('x')} < 1e-8 OR {norm('y')} < 1e-8 THEN 0 ELSE round({dot('x', 'y')} / ({norm('x')} * {norm('y')}), 6) END AS similarity FROM p")
def v5_cosine_similarity(spark, sf_dir):
    b = broken(spark, sf_dir).where(F.size("embedding") == 64)
    p = b.select("vec_id", F.col("embedding").alias("x")).join(b.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return p.select("vec_id", F.round(V.cosine_similarity("x", "y"), 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT vec_id, round({dot('x', 'y')} / (({norm('x')} + 1e-8) * ({norm('y')} + 1e-8)), 6) AS similarity FROM pairs")
def v6_batch_cosine(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(V.batch_cosine("x", "y"), 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT vec_id, round(list_distance(x::DOUBLE[], y::DOUBLE[]), 6) AS distance FROM pairs")
def v7_euclidean_distance(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(V.euclidean("x", "y"), 6).alias("distance"))


def repeated(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.unionByName(e.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))


@query("WITH r AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings WHERE vec_id % 3 = 0) SELECT min(vec_id) AS vec_id, count(*) AS refs FROM r GROUP BY list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0.0)")
def v8_dedup_vectors(spark, sf_dir):
    return ops.deduplicated(repeated(spark, sf_dir)).select("vec_id", "refs")


@query(f"SELECT vec_id, label, round({norm('embedding')}, 6) AS norm FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT -1 - vec_id, NULL, NULL FROM embeddings WHERE vec_id % 7 = 1")
def v9_get_vectors(spark, sf_dir):
    """Every seventh vector, and as many unknown ids, which have nulls."""
    e = table(spark, sf_dir, "embeddings")
    wanted = e.where("vec_id % 7 = 0").select("vec_id").unionByName(e.where("vec_id % 7 = 1").select((-1 - F.col("vec_id")).alias("vec_id")))
    return wanted.join(e, "vec_id", "left").select("vec_id", "label", F.round(V.norm("embedding"), 6).alias("norm"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY label")
def v10_remove_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    gone = e.where("vec_id % 4 = 0").select("vec_id")
    return e.join(gone, "vec_id", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings WHERE vec_id % 3 = 0), g AS (SELECT count(*) AS refs FROM r GROUP BY list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0.0)) SELECT count(*) AS unique_vectors, sum(refs)::BIGINT AS total_references, 64 AS dimension FROM g")
def v11_store_statistics(spark, sf_dir):
    d = ops.deduplicated(repeated(spark, sf_dir))
    return d.agg(F.count("*").alias("unique_vectors"), F.sum("refs").alias("total_references"), F.max(F.size("embedding")).alias("dimension"))


@query(f"WITH {Q8.format(most=255)} SELECT i AS pos, round(lo, 6) AS low, round(hi, 6) AS high FROM lim")
def v13_quantizer_calibration(spark, sf_dir):
    c = ops.calibrated(table(spark, sf_dir, "embeddings"))
    return c.select("pos", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _levels(spark, sf_dir, bits):
    e = table(spark, sf_dir, "embeddings")
    return ops.quantized(e, bits, ops.calibration(e))


@query(f"WITH {Q8.format(most=255)} SELECT vec_id, sum(level)::BIGINT AS total, max(level)::BIGINT AS most, sum(level * i)::BIGINT AS weighted FROM q GROUP BY vec_id")
def v14_quantize_8_bit(spark, sf_dir):
    return _code(_levels(spark, sf_dir, 8))


@query(f"WITH {Q8.format(most=15)} SELECT vec_id, sum(level)::BIGINT AS total, max(level)::BIGINT AS most, sum(level * i)::BIGINT AS weighted FROM q GROUP BY vec_id")
def v14_quantize_4_bit(spark, sf_dir):
    return _code(_levels(spark, sf_dir, 4))


def _code(df):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select("vec_id", total("q").alias("total"), F.array_max("q").alias("most"), total(F.transform("q", lambda x, i: x.cast("long") * i)).alias("weighted"))


@query(f"WITH {Q8.format(most=255)} SELECT vec_id, round(max(abs(x - (level / 255 * (hi - lo) + lo))), 5) AS worst FROM q GROUP BY vec_id")
def v15_dequantize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = ops.calibration(e)
    back = ops.dequantized(ops.quantized(e, 8, c), 8, c)
    gap = F.zip_with(V.doubles("embedding"), "back", lambda x, y: F.abs(x - y))
    return back.select("vec_id", F.round(F.array_max(gap), 5).alias("worst"))


@query(f"WITH {Q8.format(most=255)} SELECT i AS pos, level::BIGINT AS level FROM q WHERE vec_id = 7")
def v16_quantize_single(spark, sf_dir):
    return _levels(spark, sf_dir, 8).where("vec_id = 7").select(F.posexplode("q").alias("pos", "level"))


@query("SELECT strategy, bits, CASE WHEN strategy = 'scalar' THEN greatest(0, (1 - 9.0 / 4) * 100) WHEN strategy = 'hybrid' THEN greatest(0, (1 - 9.4 / 4) * 100) ELSE 0 END AS savings, CASE WHEN strategy = 'none' THEN 100.0 WHEN strategy = 'hybrid' THEN 99.5 WHEN bits = 8 THEN 98.5 WHEN bits = 4 THEN 95.0 ELSE 97.0 END AS accuracy, CASE WHEN strategy = 'none' THEN 0.0 ELSE 75.0 END AS actual_savings FROM (SELECT unnest(['none', 'scalar', 'hybrid']) AS strategy) CROSS JOIN (SELECT unnest([4, 8]) AS bits)")
def v17_savings_and_accuracy(spark, sf_dir):
    """A vector's bytes: one a dimension, and eight for the range, which the reference's formula counts for each vector."""
    rows = spark.createDataFrame([(s, b) for s in ("none", "scalar", "hybrid") for b in (4, 8)], "strategy string, bits int")
    cost = F.when(F.col("strategy") == "scalar", 9.0).when(F.col("strategy") == "hybrid", 9.4)
    accuracy = F.when(F.col("strategy") == "none", 100.0).when(F.col("strategy") == "hybrid", 99.5).when(F.col("bits") == 8, 98.5).when(F.col("bits") == 4, 95.0).otherwise(97.0)
    return rows.select("strategy", "bits", F.coalesce(F.greatest(F.lit(0.0), (1 - cost / 4) * 100), F.lit(0.0)).alias("savings"), accuracy.alias("accuracy"), F.when(F.col("strategy") == "none", 0.0).otherwise(75.0).alias("actual_savings"))


@query()
def v18_product_quantization(spark, sf_dir):
    """Codebooks of eight slices; k-means seeds differ between engines, so there is no SQL."""
    return search.pq_codebooks(table(spark, sf_dir, "embeddings"))

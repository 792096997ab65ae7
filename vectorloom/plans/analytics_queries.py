"""A: health, drift, clusters and index advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import analytics as A

from .registry import query, table
from .sql import norm

#: An unhealthy corpus: every 100th vector zero, every 100th after it 100 times as long, the first 20 places zero.
SICK = "sick AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE WHEN vec_id % 100 = 0 OR i <= 20 THEN 0.0 WHEN vec_id % 100 = 1 THEN x::DOUBLE * 100 ELSE x::DOUBLE END) AS embedding FROM embeddings)"
STATS = f"v AS (SELECT *, {norm('embedding')} AS norm FROM sick), s AS (SELECT avg(norm) AS m, stddev_pop(norm) AS d FROM v)"
DIMS = "x AS (SELECT unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM sick), dim AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM x GROUP BY pos)"


def sick(spark, sf_dir):
    v = lambda x, i: F.when((F.col("vec_id") % 100 == 0) | (i < 20), 0.0).when(F.col("vec_id") % 100 == 1, x.cast("double") * 100).otherwise(x.cast("double"))
    return table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", v))


HEALTH = f"""WITH {SICK}, {STATS}, {DIMS}, c AS (SELECT count(*) AS n_vectors, avg(norm) AS mean_norm, stddev_pop(norm) AS std_norm, min(norm) AS min_norm, max(norm) AS max_norm,
  sum((norm < 1e-6)::INT) AS degenerate_count, sum((abs((norm - m) / d) > 3)::INT) AS outlier_count FROM v, s),
u AS (SELECT count(*) AS dimension, sum((std < 1e-6)::INT) AS degenerate_dimensions FROM dim),
a AS (SELECT *, (dimension - degenerate_dimensions) / dimension AS utilization FROM c, u)
SELECT n_vectors, round(mean_norm, 6) AS mean_norm, round(std_norm, 6) AS std_norm, round(min_norm, 6) AS min_norm, round(max_norm, 6) AS max_norm, degenerate_count, outlier_count, dimension, degenerate_dimensions, round(utilization, 6) AS utilization,
  round(greatest(0, 1 - (CASE WHEN degenerate_count > 0 THEN least(0.3, degenerate_count / n_vectors) ELSE 0 END + CASE WHEN outlier_count > 0 THEN least(0.2, outlier_count / n_vectors * 0.5) ELSE 0 END
   + CASE WHEN utilization < 0.8 THEN (0.8 - utilization) * 0.3 ELSE 0 END + CASE WHEN mean_norm < 0.1 THEN 0.2 WHEN mean_norm > 10 THEN 0.1 ELSE 0 END + CASE WHEN mean_norm > 0 AND std_norm / mean_norm > 0.5 THEN 0.1 ELSE 0 END)), 6) AS health_score FROM a"""


@query(HEALTH)
def a1_corpus_health(spark, sf_dir):
    h = A.corpus_health(sick(spark, sf_dir))
    return h.select(*[A.r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in h.dtypes])


@query(f"WITH {SICK}, {DIMS}, t AS (SELECT sum(std * std) AS total FROM dim) SELECT pos, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max, round(std * std / total, 6) AS variance_ratio, std < 1e-6 AS is_degenerate FROM dim, t")
def a2_dimension_statistics(spark, sf_dir):
    d = A.dimension_stats(sick(spark, sf_dir))
    return d.select("pos", *[A.r(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "variance_ratio")], "is_degenerate")


@query("SELECT c_custkey AS n, round((CASE WHEN c_custkey % 3 > 0 THEN least(0.3, (c_custkey % 3) / c_custkey) ELSE 0 END + CASE WHEN c_custkey % 5 > 0 THEN least(0.2, (c_custkey % 5) / c_custkey * 0.5) ELSE 0 END + CASE WHEN (c_custkey % 100) / 100 < 0.8 THEN (0.8 - (c_custkey % 100) / 100) * 0.3 ELSE 0 END + CASE WHEN (c_custkey % 13) < 0.1 THEN 0.2 WHEN (c_custkey % 13) > 10 THEN 0.1 ELSE 0 END + CASE WHEN (c_custkey % 13) > 0 AND (c_custkey % 7) / (c_custkey % 13) > 0.5 THEN 0.1 ELSE 0 END), 6) AS penalty FROM customer")
def a3_health_score(spark, sf_dir):
    n = F.col("c_custkey")
    p = A.health_penalty(n, n % 3, n % 5, n % 100 / 100, n % 13, n % 7)
    return table(spark, sf_dir, "customer").select(n.alias("n"), F.round(p, 6).alias("penalty"))


@query(f"WITH {SICK}, {STATS} SELECT vec_id, round(norm, 6) AS norm, round(list_avg(embedding), 6) + 0.0 AS mean, round(list_stddev_pop(embedding), 6) AS std, round(len(list_filter(embedding, lambda x: abs(x) < 1e-6)) / 64, 6) AS sparsity, round(abs((norm - m) / d), 6) AS z, abs((norm - m) / d) > 3 AS is_outlier, norm < 1e-6 AS is_degenerate FROM v, s")
def a4_vector_health(spark, sf_dir):
    h = A.vector_health(sick(spark, sf_dir))
    return h.select("vec_id", *[A.r(F.col(c)).alias(c) for c in ("norm", "mean", "std", "sparsity", "z")], "is_outlier", "is_degenerate")


#: Drift: the first 70 % of the ids against the rest, which is moved by 0.05.
SIDES = "o AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS n, count(*) OVER () AS total FROM embeddings), sides AS (SELECT vec_id, CASE WHEN n <= greatest(1, floor(total * 0.7)) THEN 'baseline' ELSE 'current' END AS side, CASE WHEN n <= greatest(1, floor(total * 0.7)) THEN embedding::DOUBLE[] ELSE list_transform(embedding, lambda x: x::DOUBLE + 0.05) END AS embedding FROM o)"
SHIFT = "x AS (SELECT vec_id, side, unnest(range(64)) AS pos, unnest(embedding) AS x FROM sides), sh AS (SELECT pos, avg(x) FILTER (side = 'current') - avg(x) FILTER (side = 'baseline') AS shift FROM x GROUP BY pos)"
KS = f"len AS (SELECT sqrt(sum(shift * shift)) AS l, list(shift ORDER BY pos) AS s FROM sh), p AS (SELECT side, round(list_dot_product(embedding, s) / l, 6) AS v FROM sides, len), n AS (SELECT count(*) FILTER (side = 'baseline') AS n1, count(*) FILTER (side = 'current') AS n2 FROM p), cdf AS (SELECT v, sum(sum((side = 'baseline')::INT)) OVER (ORDER BY v) AS b, sum(sum((side = 'current')::INT)) OVER (ORDER BY v) AS c FROM p GROUP BY v), ks AS (SELECT max(abs(b / n1 - c / n2)) AS ks_statistic, any_value(n1) AS n1, any_value(n2) AS n2 FROM cdf, n)"
OVERLAP = "f AS (SELECT side, x, row_number() OVER (PARTITION BY side ORDER BY vec_id, pos) AS i FROM x QUALIFY i <= 1000), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM f), h AS (SELECT least(48, floor((x - lo) / ((hi - lo) / 49))) AS bin, count(*) FILTER (side = 'baseline') / (SELECT count(*) FROM f WHERE side = 'baseline') AS h1, count(*) FILTER (side = 'current') / (SELECT count(*) FROM f WHERE side = 'current') AS h2 FROM f, lim GROUP BY bin), ov AS (SELECT sum(least(h1, h2)) AS overlap FROM h)"
MEAN = "ms AS (SELECT sqrt(sum(shift * shift)) AS mean_shift FROM sh), sc AS (SELECT stddev_pop(x) FILTER (side = 'current') / (stddev_pop(x) FILTER (side = 'baseline') + 1e-8) AS std_change FROM x)"
P = "least(1.0, 2 * exp(-2 * pow(sqrt(n1 * n2 / (n1 + n2)) * ks_statistic, 2)))"
SEVERITY = "CASE WHEN mean_shift > 1 OR ks_statistic > 0.3 OR overlap < 0.5 THEN 'high' WHEN mean_shift > 0.5 OR ks_statistic > 0.15 OR overlap < 0.7 THEN 'medium' WHEN mean_shift > 0.2 OR ks_statistic > 0.05 OR overlap < 0.85 THEN 'low' ELSE 'none' END"


def sides(spark, sf_dir):
    s = A.split(table(spark, sf_dir, "embeddings").withColumn("embedding", V.doubles("embedding")))
    return s.withColumn("embedding", F.when(F.col("side") == "current", F.transform("embedding", lambda x: x + 0.05)).otherwise(F.col("embedding")))


@query(f"WITH {SIDES}, {SHIFT}, {MEAN} SELECT round(mean_shift, 6) AS mean_shift, round(std_change, 6) AS std_change FROM ms, sc")
def a5_drift_statistics(spark, sf_dir):
    d = A.drift_shift(sides(spark, sf_dir))
    return d.select(F.round("mean_shift", 6).alias("mean_shift"), F.round("std_change", 6).alias("std_change"))


@query(f"WITH {SIDES}, {SHIFT}, {KS} SELECT round(ks_statistic, 6) AS ks_statistic, round({P}, 6) AS p_value FROM ks")
def a6_ks_test(spark, sf_dir):
    d = A.ks(sides(spark, sf_dir))
    return d.select(F.round("ks_statistic", 6).alias("ks_statistic"), F.round("p_value", 6).alias("p_value"))


@query(f"WITH {SIDES}, {SHIFT}, {OVERLAP} SELECT round(overlap, 6) AS overlap FROM ov")
def a7_overlap(spark, sf_dir):
    return A.overlap(sides(spark, sf_dir)).select(F.round("overlap", 6).alias("overlap"))


@query(f"WITH g AS (SELECT c_custkey AS id, (c_custkey % 13) / 10 AS mean_shift, (c_custkey % 40) / 100 AS ks_statistic, 1 - (c_custkey % 60) / 100 AS overlap FROM customer) SELECT id, {SEVERITY} AS severity FROM g")
def a8_drift_severity(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("id"), A.severity(n % 13 / 10, n % 40 / 100, 1 - n % 60 / 100).alias("severity"))


@query(f"WITH {SIDES}, {SHIFT}, {KS}, {OVERLAP}, {MEAN}, a AS (SELECT *, {P} AS p_value, {SEVERITY} AS severity FROM ms, sc, ks, ov) SELECT round(mean_shift, 6) AS mean_shift, round(p_value, 6) AS p_value, round(overlap, 6) AS overlap, severity, p_value < 0.05 AND severity IN ('medium', 'high') AS drifted, round((CASE WHEN p_value < 0.01 THEN 0.95 WHEN p_value < 0.05 THEN 0.75 ELSE 0.3 END + CASE WHEN mean_shift > 1 THEN 0.9 WHEN mean_shift > 0.5 THEN 0.7 ELSE 0.4 END + CASE WHEN overlap < 0.5 THEN 0.9 WHEN overlap < 0.7 THEN 0.7 ELSE 0.4 END) / 3, 6) AS confidence FROM a")
def a9_drift_decision(spark, sf_dir):
    d = A.drift(sides(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_shift", "p_value", "overlap", "confidence")]
    return d.select(*rounded, "severity", "drifted")


@query()
def a10_kmeans(spark, sf_dir):
    """Clusters of a fixed seed; labels are not portable between engines."""
    df, _ = A.kmeans(table(spark, sf_dir, "embeddings"))
    return A.cluster_info(df).select("cluster", "size", F.round("radius", 6).alias("radius"))


@query("SELECT least(least(50, greatest(2, floor(sqrt(count(*) / 2)))), count(*) // 5)::BIGINT AS k FROM embeddings")
def a11_cluster_count(spark, sf_dir):
    return spark.createDataFrame([(A.cluster_count(table(spark, sf_dir, "embeddings").count()),)], "k long")


#: Clusters that both engines know: the labels.
CLUSTERS = f"x AS (SELECT label AS cluster, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT cluster, list(x ORDER BY pos) AS centroid FROM (SELECT cluster, pos, avg(x) AS x FROM x GROUP BY ALL) GROUP BY cluster), d AS (SELECT vec_id, cluster, list_distance(embedding::DOUBLE[], centroid) AS d FROM embeddings JOIN m ON cluster = label)"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")


@query(f"WITH {CLUSTERS} SELECT cluster, count(*) AS size, round(avg(d), 6) AS radius, round(1 / (1 + stddev_pop(d) / (avg(d) + 1e-8)), 6) AS compactness FROM d GROUP BY cluster")
def a12_cluster_info(spark, sf_dir):
    return A.cluster_info(labelled(spark, sf_dir)).select("cluster", "size", F.round("radius", 6).alias("radius"), F.round("compactness", 6).alias("compactness"))


@query(f"WITH {CLUSTERS} SELECT vec_id, cluster, round(d, 6) AS d FROM d WHERE d > (SELECT avg(d) + 2 * stddev_pop(d) FROM d)")
def a13_cluster_outliers(spark, sf_dir):
    return A.cluster_outliers(labelled(spark, sf_dir)).withColumn("d", F.round("d", 6))


@query("WITH p AS (SELECT a.vec_id, a.label = b.label AS same, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b), s AS (SELECT vec_id, sum(CASE WHEN same THEN d ELSE 0 END) / sum(same::INT) AS a, min(d) FILTER (NOT same) AS b FROM p GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s")
def a14_silhouette(spark, sf_dir):
    """All vectors, at every scale."""
    return A.silhouette(labelled(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"WITH {CLUSTERS}, s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY cluster), w AS (SELECT a.cluster, max((sa.s + sb.s) / list_distance(a.centroid, b.centroid)) AS worst FROM m a JOIN m b ON a.cluster <> b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY a.cluster) SELECT round(avg(worst), 6) AS davies_bouldin FROM w")
def a15_davies_bouldin(spark, sf_dir):
    return A.davies_bouldin(labelled(spark, sf_dir)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"WITH {CLUSTERS} SELECT round(sum(d * d), 6) AS inertia FROM d")
def a16_inertia(spark, sf_dir):
    return A.cluster_info(labelled(spark, sf_dir)).agg(F.round(F.sum("inertia"), 6).alias("inertia"))


ADVICE = """WITH p AS (SELECT c_custkey AS id, (c_custkey * c_custkey * 97) % 20000000 AS n, CASE c_custkey % 3 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'hnsw' ELSE 'ivf' END AS cur, c_custkey % 11 AS i, c_custkey % 7 AS s FROM customer),
r AS (SELECT *, i / greatest(i + s, 1e-9) AS wr FROM p), b AS (SELECT *, CASE WHEN n < 1000 OR wr > 0.5 THEN 'brute_force' WHEN n <= 10000000 THEN 'hnsw' ELSE 'ivf' END AS best,
 least(1.0, greatest(0.0, 0.5 + CASE WHEN n < 1000 THEN 0.4 ELSE 0 END + CASE WHEN n > 1000000 THEN 0.3 ELSE 0 END - CASE WHEN n BETWEEN 1000 AND 2000 THEN 0.2 ELSE 0 END + CASE WHEN cur = 'brute_force' AND n > 100000 THEN 0.3 ELSE 0 END)) AS conf FROM r),
c AS (SELECT *, CASE WHEN cur = best THEN 'none' WHEN cur = 'brute_force' OR n < 10000 THEN 'low' WHEN n < 1000000 THEN 'medium' ELSE 'high' END AS cost FROM b) """


def advice(spark, sf_dir):
    n = F.col("c_custkey")
    kind = F.when(n % 3 == 0, "brute_force").when(n % 3 == 1, "hnsw").otherwise("ivf")
    return A.index_advice(table(spark, sf_dir, "customer").select(n.alias("id"), (n * n * 97 % 20_000_000).alias("vector_count"), kind.alias("current_index_type"), (n % 11).alias("inserts"), (n % 7).alias("searches")))


@query(ADVICE + "SELECT id, round(wr, 6) AS write_ratio, best AS recommended FROM c")
def a17_index_oracle(spark, sf_dir):
    return advice(spark, sf_dir).select("id", "write_ratio", "recommended")


@query(ADVICE + "SELECT id, round(conf, 6) AS confidence, round(CASE WHEN cur = best THEN NULL WHEN cur = 'brute_force' AND best = 'hnsw' THEN least(100, n / 1000) WHEN cur = 'brute_force' AND best = 'ivf' THEN least(50, n / 5000) WHEN cur = 'hnsw' AND best = 'ivf' THEN 0.8 WHEN cur = 'ivf' AND best = 'hnsw' THEN 1.5 ELSE 1.0 END, 6) AS speedup, cost, conf > 0.8 AND cost = 'low' AS auto_migrate FROM c")
def a18_oracle_confidence(spark, sf_dir):
    return advice(spark, sf_dir).select("id", "confidence", "speedup", "cost", "auto_migrate")


@query("SELECT source AS corpus, count(*) AS documents, count(vec_id) AS chunks, max(len(embedding)) AS dimension FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source")
def a19_corpus_statistics(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"], "left").groupBy(F.col("source").alias("corpus")).agg(F.count("*").alias("documents"), F.count("vec_id").alias("chunks"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("dimension"))


@query("SELECT event_type, CASE WHEN user_id % 200 <= 10 THEN 'small' WHEN user_id % 200 <= 100 THEN 'medium' ELSE 'large' END AS batch, count(*) AS requests, sum((value <= 10)::INT)::BIGINT AS le_10, sum((value <= 50)::INT)::BIGINT AS le_50, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def a21_metrics(spark, sf_dir):
    """Counters and cumulative histogram buckets."""
    size = F.col("user_id") % 200
    e = table(spark, sf_dir, "events").withColumn("batch", F.when(size <= 10, "small").when(size <= 100, "medium").otherwise("large"))
    le = lambda b: F.sum((F.col("value") <= b).cast("int")).alias(f"le_{b}")
    return e.groupBy("event_type", "batch").agg(F.count("*").alias("requests"), le(10), le(50), F.round(F.sum("value"), 4).alias("total"))

"""Embedding health, drift, clustering and index advice, as aggregates over (vec_id, embedding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V

from .vectors import dimension_rows

PLACES = 6
DEGENERATE, OUTLIER, UTILIZATION = 1e-6, 3.0, 0.8


def r(c: Column, n: int = PLACES) -> Column:
    """Rounded, and never negative zero."""
    return F.round(c, n) + F.lit(0.0)


# ---- health -------------------------------------------------------------------------------------------------------


def norms(df: DataFrame) -> DataFrame:
    return df.select("vec_id", V.norm("embedding").alias("norm"))


def vector_health(df: DataFrame) -> DataFrame:
    """One row a vector: norm, mean, std, sparsity, z-score of the norm, and whether it is an outlier or degenerate."""
    stats = df.agg(F.avg(V.norm("embedding")).alias("m"), F.stddev_pop(V.norm("embedding")).alias("s")).first()
    m, s = stats["m"] or 0.0, stats["s"] or 0.0
    rows = df.select("vec_id", V.norm("embedding").alias("norm"), V.mean("embedding").alias("mean"), V.std("embedding").alias("std"), V.sparsity("embedding").alias("sparsity"))
    z = F.abs((F.col("norm") - m) / s) if s > 0 else F.lit(0.0)
    return rows.withColumn("z", z).withColumn("is_outlier", F.col("z") > OUTLIER).withColumn("is_degenerate", F.col("norm") < DEGENERATE)


def dimension_stats(df: DataFrame) -> DataFrame:
    """One row a dimension: mean, std, min, max, its share of all variance, and whether it hardly varies."""
    d = dimension_rows(df).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    total = F.sum(F.col("std") * F.col("std")).over(Window.partitionBy(F.lit(1)))  # one row a dimension
    share = F.when(total > 0, F.col("std") * F.col("std") / total).otherwise(0.0)
    return d.withColumn("variance_ratio", share).withColumn("is_degenerate", F.col("std") < DEGENERATE)


def health_penalty(n: Column, degenerate: Column, outliers: Column, utilization: Column, mean: Column, std: Column) -> Column:
    parts = [
        F.when(degenerate > 0, F.least(F.lit(0.3), degenerate / n)).otherwise(0.0),
        F.when(outliers > 0, F.least(F.lit(0.2), outliers / n * 0.5)).otherwise(0.0),
        F.when(utilization < UTILIZATION, (UTILIZATION - utilization) * 0.3).otherwise(0.0),
        F.when(mean < 0.1, 0.2).when(mean > 10, 0.1).otherwise(0.0),
        F.when((mean > 0) & (std / mean > 0.5), 0.1).otherwise(0.0),
    ]
    return parts[0] + parts[1] + parts[2] + parts[3] + parts[4]


def corpus_health(df: DataFrame) -> DataFrame:
    """One row: norms, counts of degenerate vectors, outliers and dimensions, utilization and the health score."""
    v = vector_health(df).agg(
        F.count("*").alias("n_vectors"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"), F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"),
        F.sum(F.col("is_degenerate").cast("long")).alias("degenerate_count"), F.sum(F.col("is_outlier").cast("long")).alias("outlier_count"),
    )
    d = dimension_stats(df).agg(F.count("*").alias("dimension"), F.sum(F.col("is_degenerate").cast("long")).alias("degenerate_dimensions"))
    both = v.withColumn("one", F.lit(1)).join(d.withColumn("one", F.lit(1)), "one").drop("one")
    both = both.withColumn("utilization", (F.col("dimension") - F.col("degenerate_dimensions")) / F.col("dimension"))
    penalty = health_penalty(*[F.col(c) for c in ("n_vectors", "degenerate_count", "outlier_count", "utilization", "mean_norm", "std_norm")])
    return both.withColumn("health_score", F.greatest(F.lit(0.0), 1 - penalty))


#: Ranges of ids that are counted at once.
RANGES = 1024


# ---- drift --------------------------------------------------------------------------------------------------------


def split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Add `side`: baseline for the first share of the ids, current for the rest. The border is found by counting ranges of ids,
    narrower each time, so that no task orders them all."""
    low, high, n = df.agg(F.min("vec_id"), F.max("vec_id"), F.count("vec_id")).first()
    place = max(1, int(n * share))  # of the last id of the baseline
    while n and low < high:
        width = -(-(high - low + 1) // RANGES)
        part = df.where(F.col("vec_id").between(low, high)).groupBy(F.expr(f"(vec_id - {low}) div {width}").alias("part")).count()
        for r in part.orderBy("part").collect():  # at most RANGES rows
            if r["count"] >= place:
                low, high = low + r["part"] * width, min(high, low + (r["part"] + 1) * width - 1)
                break
            place -= r["count"]
    return df.withColumn("side", F.when(F.col("vec_id") <= F.lit(low if n else -1), "baseline").otherwise("current"))


def dimension_shifts(sides: DataFrame) -> DataFrame:
    """(pos, shift) of the mean of each dimension from baseline to current."""
    d = sides.select("side", F.posexplode("embedding").alias("pos", "x"))
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("x").cast("double")))
    return d.groupBy("pos").agg((mean("current") - mean("baseline")).alias("shift"))


def drift_shift(sides: DataFrame) -> DataFrame:
    """One row: the means' distance, and the ratio of the standard deviations of all values."""
    shift = dimension_shifts(sides).agg(F.sqrt(F.sum(F.col("shift") * F.col("shift"))).alias("mean_shift"))
    sd = lambda s: F.stddev_pop(F.when(F.col("side") == s, F.col("x").cast("double")))
    std = sides.select("side", F.explode("embedding").alias("x")).agg((sd("current") / (sd("baseline") + 1e-8)).alias("std_change"))
    return shift.withColumn("one", F.lit(1)).join(std.withColumn("one", F.lit(1)), "one").drop("one")


def ks(sides: DataFrame) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov statistic of projections on the line between the means, and its p-value.

    Values are counted in a grid of their six rounded places, and cumulated within and across blocks, so no task sorts them all.
    """
    shift = [x["shift"] for x in dimension_shifts(sides).orderBy("pos").collect()]  # as long as one vector
    length = sum(x * x for x in shift) ** 0.5 or 1.0
    line = F.array(*[F.lit(x / length) for x in shift])
    p = sides.select("side", F.round(V.dot("embedding", line), PLACES).alias("v"))
    counts = p.groupBy("v").agg(F.sum(F.when(F.col("side") == "baseline", 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("side") == "current", 1).otherwise(0)).alias("c"))
    counts = counts.withColumn("block", F.floor(F.col("v") * 100))
    within = Window.partitionBy("block").orderBy("v")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over at most a few hundred blocks
    sums = counts.groupBy("block").agg(F.sum("b").alias("sb"), F.sum("c").alias("sc"))
    sums = sums.select("block", F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("pb"), F.coalesce(F.sum("sc").over(before), F.lit(0)).alias("pc"))
    n1, n2 = p.agg(F.sum(F.when(F.col("side") == "baseline", 1).otherwise(0)), F.sum(F.when(F.col("side") == "current", 1).otherwise(0))).first()
    gap = F.abs((F.col("pb") + F.sum("b").over(within)) / n1 - (F.col("pc") + F.sum("c").over(within)) / n2)
    d = counts.join(sums, "block").select(gap.alias("gap")).agg(F.max("gap").alias("ks_statistic"))
    en = (n1 * n2 / (n1 + n2)) ** 0.5
    return d.withColumn("p_value", F.least(F.lit(1.0), 2 * F.exp(-2 * F.pow(en * F.col("ks_statistic"), 2))))


def overlap(sides: DataFrame, values: int = 1000, bins: int = 49) -> DataFrame:
    """One row: the histograms' overlap, over the first values of either side in the order of ids and places."""
    width = F.size("embedding")
    # a vector has at least one value, so the first `values` vectors of a side are enough; each side's are a bounded top-k
    top = [sides.where(F.col("side") == s).orderBy("vec_id").limit(values) for s in ("baseline", "current")]
    first = top[0].unionByName(top[1]).withColumn("n", F.row_number().over(Window.partitionBy("side").orderBy("vec_id"))).where((F.col("n") - 1) * width < values)
    x = first.select("side", "n", width.alias("w"), F.posexplode("embedding").alias("pos", "x")).where((F.col("n") - 1) * F.col("w") + F.col("pos") < values)
    x = x.withColumn("x", F.col("x").cast("double"))
    low, high = x.agg(F.min("x"), F.max("x")).first()
    step = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / step)) if step else F.lit(0)
    n = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    hist = x.groupBy(b.alias("bin")).agg(n("baseline").alias("h1"), n("current").alias("h2"))
    n1, n2 = x.agg(n("baseline"), n("current")).first()
    density = F.least(F.col("h1") / n1, F.col("h2") / n2)
    return hist.agg(F.sum(density).alias("overlap"))


def severity(shift: Column, statistic: Column, share: Column) -> Column:
    return (
        F.when((shift > 1) | (statistic > 0.3) | (share < 0.5), "high")
        .when((shift > 0.5) | (statistic > 0.15) | (share < 0.7), "medium")
        .when((shift > 0.2) | (statistic > 0.05) | (share < 0.85), "low")
        .otherwise("none")
    )


def drift(sides: DataFrame) -> DataFrame:
    """One row: all drift statistics, severity, whether it is drift, and how sure that is."""
    n = sides.groupBy("side").count().collect()
    if len(n) < 2 or min(x["count"] for x in n) < 30:
        raise ValueError("either side needs 30 vectors")
    one = lambda df: df.withColumn("one", F.lit(1))
    all_ = one(drift_shift(sides)).join(one(ks(sides)), "one").join(one(overlap(sides)), "one").drop("one")
    all_ = all_.withColumn("severity", severity(F.col("mean_shift"), F.col("ks_statistic"), F.col("overlap")))
    p = F.when(F.col("p_value") < 0.01, 0.95).when(F.col("p_value") < 0.05, 0.75).otherwise(0.3)
    alike = F.when(F.col("overlap") < 0.5, 0.9).when(F.col("overlap") < 0.7, 0.7).otherwise(0.4)
    confidence = (p + F.when(F.col("mean_shift") > 1, 0.9).when(F.col("mean_shift") > 0.5, 0.7).otherwise(0.4) + alike) / 3
    return all_.withColumn("drifted", (F.col("p_value") < 0.05) & F.col("severity").isin("medium", "high")).withColumn("confidence", confidence)


# ---- clusters -----------------------------------------------------------------------------------------------------


def cluster_count(n: int, most: int = 50, least_size: int = 5) -> int:
    k = min(min(most, max(2, int((n / 2) ** 0.5))), n // least_size)
    if k < 1:
        raise ValueError("too few vectors to cluster")
    return k


def kmeans(df: DataFrame, k: int | None = None, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """`df` with a `cluster`, and the centroids: k-means|| from a fixed seed, at most 100 rounds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("features", array_to_vector(V.doubles("embedding")))
    model = KMeans(k=k or cluster_count(df.count()), seed=seed, maxIter=100, tol=1e-4, initMode="k-means||").fit(rows)
    return model.transform(rows).drop("features").withColumnRenamed("prediction", "cluster"), [[float(x) for x in c] for c in model.clusterCenters()]


def centroids(df: DataFrame) -> DataFrame:
    """(cluster, centroid): mean vectors of given clusters."""
    means = df.select("cluster", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def distances(df: DataFrame) -> DataFrame:
    """Add `d`, the distance from the mean of the vector's cluster; centroids are few and small."""
    return df.join(F.broadcast(centroids(df)), "cluster").withColumn("d", V.euclidean("embedding", "centroid")).drop("centroid")


def cluster_info(df: DataFrame) -> DataFrame:
    """(cluster, size, radius, compactness, inertia)."""
    g = distances(df).groupBy("cluster").agg(F.count("*").alias("size"), F.avg("d").alias("radius"), F.stddev_pop("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("inertia"))
    return g.withColumn("compactness", 1 / (1 + F.col("s") / (F.col("radius") + 1e-8))).drop("s")


def cluster_outliers(df: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Vectors farther from their mean than the mean distance and so many deviations of it, over all."""
    d = distances(df)
    m, s = d.agg(F.avg("d"), F.stddev_pop("d")).first()
    return d.where(F.col("d") > (m or 0.0) + sigmas * (s or 0.0)).select("vec_id", "cluster", "d")


def davies_bouldin(df: DataFrame) -> DataFrame:
    """One row; pairs are of centroids, of which there are few."""
    s = cluster_info(df).select("cluster", F.col("radius").alias("s"))
    c = centroids(df).join(s, "cluster")
    o = c.select(F.col("cluster").alias("c2"), F.col("centroid").alias("m2"), F.col("s").alias("s2"), F.lit(1).alias("one"))
    pairs = c.withColumn("one", F.lit(1)).join(F.broadcast(o), "one").where("cluster <> c2").withColumn("gap", V.euclidean("centroid", "m2")).where("gap > 0")
    return pairs.groupBy("cluster").agg(F.max((F.col("s") + F.col("s2")) / F.col("gap")).alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


#: Vectors of a block, and those of it that a task compares with another block at once.
SILHOUETTE_BLOCK, SILHOUETTE_ROWS = 8192, 256


def silhouette(df: DataFrame) -> DataFrame:
    """One row: the reference form, over all vectors. `a` counts the distance to itself; `b` is the nearest vector of another cluster.

    The vectors are dealt into at least four blocks of at most about SILHOUETTE_BLOCK; each meets every block in a task, which returns the sum and number
    of distances within its cluster and the least to others, and a groupBy merges these. Work is the square of the vectors' number,
    what a task holds is not."""
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    rows = df.select("vec_id", "cluster", "embedding").where("cluster is not null and embedding is not null")
    n = rows.count()
    if not n:
        return spark.createDataFrame([(0.0,)], "silhouette double")
    blocks = max(4, -(-n // SILHOUETTE_BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "total": [], "n": [], "least": []})
        x, label = np.stack(right["embedding"].to_numpy()).astype(float), right["cluster"].to_numpy()
        out = []
        for at in range(0, len(left), SILHOUETTE_ROWS):
            part = left.iloc[at : at + SILHOUETTE_ROWS]
            m = np.stack(part["embedding"].to_numpy()).astype(float)
            d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * m @ x.T))
            d[part["vec_id"].to_numpy()[:, None] == right["vec_id"].to_numpy()[None]] = 0
            same = part["cluster"].to_numpy()[:, None] == label[None]
            out.append(pd.DataFrame({"vec_id": part["vec_id"], "total": np.where(same, d, 0).sum(1), "n": same.sum(1), "least": np.where(same, np.inf, d).min(1)}))
        return pd.concat(out)

    kind = df.schema["vec_id"].dataType.simpleString()
    right = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = met.groupBy("own", "other").cogroup(right.groupBy("first", "own")).applyInPandas(meet, f"vec_id {kind}, total double, n long, least double")
    g = parts.groupBy("vec_id").agg((F.sum("total") / F.sum("n")).alias("a"), F.min("least").alias("b"))
    top = F.greatest("a", "b")
    s = F.when((F.col("b") < float("inf")) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return g.agg(F.avg(s).alias("silhouette"))


def silhouette_of_sample(df: DataFrame, sample: int = 1000) -> DataFrame:
    """One row: the reference form, over a sample of at most `sample` vectors, the first by a hash of the id. `a` counts the distance
    to itself; `b` is the nearest vector of another cluster. A task compares its vectors with the sample, which is bounded."""
    import numpy as np
    import pandas as pd

    rows = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("cluster", "embedding")
    pdf = rows.toPandas()
    if not len(pdf):
        return df.sparkSession.createDataFrame([(0.0,)], "silhouette double")
    x, label = np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["cluster"].to_numpy()
    block = df.sparkSession.sparkContext.broadcast((x, label))

    def one(batches):
        x, label = block.value
        for b in batches:
            if len(b):
                m = np.stack(b["embedding"].to_numpy()).astype(float)
                d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * m @ x.T))
                same = b["cluster"].to_numpy()[:, None] == label[None]
                a = np.where(same, d, 0).sum(1) / np.maximum(1, same.sum(1))
                other = np.where(same, np.inf, d).min(1)
                top = np.maximum(a, other)
                yield pd.DataFrame({"s": np.where(np.isfinite(other) & (top > 0), (np.where(np.isfinite(other), other, 0) - a) / np.where(top > 0, top, 1), 0.0)})

    return rows.mapInPandas(one, "s double").agg(F.avg("s").alias("silhouette"))


# ---- index advice -------------------------------------------------------------------------------------------------

BRUTE_FORCE_MAX, LARGE, GRAPH_MAX, WRITE_HEAVY = 1_000, 1_000_000, 10_000_000, 0.5


def index_advice(profiles: DataFrame) -> DataFrame:
    """From (vector_count, current_index_type, inserts, searches): the index to use, how sure that is, what is gained and what moving costs."""
    n, current = F.col("vector_count"), F.col("current_index_type")
    writes = F.col("inserts") / F.greatest(F.col("inserts") + F.col("searches"), F.lit(1e-9))
    choice = F.when(n < BRUTE_FORCE_MAX, "brute_force").when(writes > WRITE_HEAVY, "brute_force").when(n <= GRAPH_MAX, "hnsw").otherwise("ivf")
    sure = 0.5 + F.when(n < BRUTE_FORCE_MAX, 0.4).otherwise(0.0) + F.when(n > LARGE, 0.3).otherwise(0.0)
    sure = sure - F.when((n >= BRUTE_FORCE_MAX) & (n <= 2 * BRUTE_FORCE_MAX), 0.2).otherwise(0.0) + F.when((current == "brute_force") & (n > 100_000), 0.3).otherwise(0.0)
    best = F.col("recommended")
    gain = (
        F.when(current == best, None)
        .when((current == "brute_force") & (best == "hnsw"), F.least(F.lit(100.0), n / 1000))
        .when((current == "brute_force") & (best == "ivf"), F.least(F.lit(50.0), n / 5000))
        .when((current == "hnsw") & (best == "ivf"), 0.8)
        .when((current == "ivf") & (best == "hnsw"), 1.5)
        .otherwise(1.0)
    )
    cost = F.when(current == best, "none").when((current == "brute_force") | (n < 10_000), "low").when(n < 1_000_000, "medium").otherwise("high")
    out = profiles.withColumn("write_ratio", r(writes)).withColumn("recommended", choice).withColumn("confidence", r(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure))))
    return out.withColumn("speedup", r(gain)).withColumn("cost", cost).withColumn("auto_migrate", (F.col("confidence") > 0.8) & (F.col("cost") == "low"))

"""Rank fusion, query expansion, temperature sampling and feedback.

Fusion reads (strategy, query_id, vec_id, score, place), place from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6
#: The weights of strategies that are given none.
DEFAULT_WEIGHTS = {"vector": 0.7, "keyword": 0.3, "metadata": 0.2}
OTHER = 0.5


def _weight(weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, w in weights.items():
        out = F.when(F.col("strategy") == name, float(w)).otherwise(out)
    return out


def _ranked(df: DataFrame, score: Column, places: int = PLACES) -> DataFrame:
    fused = df.groupBy("query_id", "vec_id").agg(F.round(score, places).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def rrf(df: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion. Given weights that lack a strategy count 1 for it."""
    w = _weight(DEFAULT_WEIGHTS, OTHER) if weights is None else _weight(weights, 1.0)
    return _ranked(df, F.sum(w / (k + F.col("place") + 1)))


def linear(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return _ranked(df, F.sum(_weight(DEFAULT_WEIGHTS if weights is None else weights, OTHER) * F.col("score")), PLACES + 2)


def fuse(df: DataFrame, method: str = "rrf", weights: dict[str, float] | None = None) -> DataFrame:
    """`linear`, or reciprocal ranks for every other method; the method is reported as asked."""
    return (linear(df, weights) if method == "linear" else rrf(df, weights)).withColumn("method", F.lit(method))


def best_of(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The largest weighted score that any strategy gives."""
    return _ranked(df, F.max(_weight(weights or {}, 1.0) * F.col("score")))


def confidence(df: DataFrame, first: int = 10) -> DataFrame:
    """(query_id, confidence): mean Jaccard similarity of the strategies' first results; 1 for one strategy, 0.5 where none has results."""
    sets = df.where(F.col("place") < first).groupBy("query_id", "strategy").agg(F.collect_set("vec_id").alias("ids"))
    other = sets.select("query_id", F.col("strategy").alias("s2"), F.col("ids").alias("ids2"))
    pairs = sets.join(other, "query_id").where("strategy < s2")
    jaccard = F.size(F.array_intersect("ids", "ids2")) / F.size(F.array_union("ids", "ids2"))
    mean = pairs.groupBy("query_id").agg(F.avg(jaccard).alias("c"))
    n = df.groupBy("query_id").agg(F.countDistinct("strategy").alias("n"))
    return n.join(mean, "query_id", "left").select("query_id", F.round(F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce("c", F.lit(0.5))), PLACES).alias("confidence"))


#: Synonyms and more specific terms. Keys in capitals never match, for words are in lower case.
SYNONYMS = {
    "car": ["automobile", "vehicle"],
    "ML": ["machine learning", "ML"],
    "AI": ["artificial intelligence", "AI"],
    "python": ["python programming", "python language"],
    "search": ["find", "lookup", "query"],
    "database": ["DB", "datastore", "data store"],
}
SPECIFIC = {
    "tutorial": ["beginner tutorial", "tutorial guide", "how to"],
    "guide": ["complete guide", "getting started", "documentation"],
    "example": ["code example", "sample code", "demo"],
}


def _dictionary(entries: dict[str, list[str]]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*[F.array(*map(F.lit, v)) for v in entries.values()]))


def expanded(queries: DataFrame, strategy: str = "balanced", most: int = 5) -> DataFrame:
    """(query_id, pos, text, weight, kind, confidence) from (query_id, query): the query itself and up to `most` variants, words in order."""
    if strategy not in ("conservative", "balanced", "aggressive"):
        raise ValueError(f"unknown strategy: {strategy}")
    query = F.col("query")
    lower = F.lower(query)
    tokens = F.filter(F.split(lower, r"\s+"), lambda w: w != "")
    variant = lambda text, weight, kind, conf: F.struct(text.alias("text"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"))

    def replaced(entries: dict, weight: float, kind: str, conf: float) -> Column:
        none = F.array().cast("array<string>")
        of = lambda w: F.transform(F.coalesce(F.try_element_at(_dictionary(entries), w), none), lambda t: F.replace(lower, w, t))
        texts = F.filter(F.flatten(F.transform(tokens, of)), lambda t: t != lower)
        return F.transform(texts, lambda t: variant(t, weight, kind, conf))

    parts = [F.array(variant(query, 1.0, "original", 1.0)), replaced(SYNONYMS, 0.8, "synonym", 0.9)]
    if strategy != "conservative":
        parts.append(replaced(SPECIFIC, 0.7, "specific", 0.7))
    if strategy == "aggressive":
        forms = F.array(F.concat(F.lit("how to "), query), F.concat(query, F.lit(" guide")), F.concat(query, F.lit(" tutorial")), F.concat(F.lit("learn "), query))
        parts.append(F.transform(forms, lambda t: variant(t, 0.6, "paraphrase", 0.6)))
    return queries.select("query_id", F.posexplode(F.slice(F.concat(*parts), 1, most + 1)).alias("pos", "v")).select("query_id", "pos", "v.*")


def recall_improvement(original: DataFrame, merged: DataFrame) -> DataFrame:
    """(query_id, improvement): the share of merged results that the original lacks."""
    new = merged.join(original.select("query_id", "vec_id", F.lit(1).alias("old")), ["query_id", "vec_id"], "left")
    return new.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)) / F.count("*"), PLACES).alias("improvement"))


def temperature_sample(results: DataFrame, k: int, temperature: float = 1.0, multiplier: int = 5, seed: int = 42) -> DataFrame:
    """k of the first k * multiplier results, without replacement, with probabilities exp(-distance) ** (1 / T): the largest keys
    -distance / T + Gumbel noise. The noise follows from the seed and the ids, so reruns agree. Sorted by distance."""
    w = Window.partitionBy("query_id")
    if temperature == 0:
        return results.where(F.col("rank") <= k)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("vec_id").cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    key = -F.col("distance") / temperature - F.log(-F.log(u))
    drawn = results.where(F.col("rank") <= k * multiplier).withColumn("key", key).withColumn("drawn", F.row_number().over(w.orderBy(F.desc("key"), "vec_id"))).where(F.col("drawn") <= k)
    return drawn.drop("key", "drawn").withColumn("rank", F.row_number().over(w.orderBy("distance", "vec_id")))


def diversity(results: DataFrame) -> DataFrame:
    """(query_id, diversity): the distances' population variance, at most 1; 0 for fewer than two."""
    return results.groupBy("query_id").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.round(F.least(F.var_pop("distance"), F.lit(1.0)), 4)).alias("diversity"))


#: Temperatures for uses; others count as balanced.
TEMPERATURES = {"precision": 0.0, "balanced": 1.0, "diversity": 1.5, "exploration": 2.0}
#: What a unit of feedback is worth; other signals count 0.5.
SIGNALS = {"click": 0.5, "dwell": 0.7, "skip": -0.3, "bookmark": 1.0}
LEARNING_RATE = 0.1


def _choice(c: str, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def temperature_for(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("temperature", _choice(column, TEMPERATURES, TEMPERATURES["balanced"]))


def feedback_boosts(feedback: DataFrame) -> DataFrame:
    """(vec_id, boost) of (vec_id, signal, strength)."""
    return feedback.groupBy("vec_id").agg(F.sum(_choice("signal", SIGNALS, 0.5) * F.col("strength") * LEARNING_RATE).alias("boost"))


def feedback_rerank(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Scores times 1 + boost, ranked anew; ties keep their order."""
    scored = results.join(feedback_boosts(feedback), "vec_id", "left").withColumn("score", F.round(F.col("score") * (1 + F.coalesce("boost", F.lit(0.0))), PLACES))
    return scored.withColumnRenamed("rank", "old_rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "old_rank")))

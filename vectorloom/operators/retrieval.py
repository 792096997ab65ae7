"""What follows a search: filters, scores, reranking, hydration and context.

Results are (query_id, vec_id, distance, rank) with the chunk's columns: chunk_index, created_at, text, label.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6


def _per_query(*order: Column | str) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each query, ranked anew."""
    return df.withColumn("rank", F.row_number().over(_per_query(*order))).where(F.col("rank") <= k)


def predicate(field: Column, op: str, value) -> Column:
    """The filter operators, never null: a missing value equals only null, differs from everything else, and has no order."""
    lit = None if isinstance(value, (list, tuple)) else F.lit(value)
    if op == "eq":
        return field.eqNullSafe(lit)
    if op == "ne":
        return ~field.eqNullSafe(lit)
    if op in ("gt", "lt", "gte", "lte"):
        return F.coalesce({"gt": field > lit, "lt": field < lit, "gte": field >= lit, "lte": field <= lit}[op], F.lit(False))
    if op == "in":
        return F.coalesce(field.isin(list(value)), F.lit(False))
    if op == "contains":
        return F.coalesce(F.contains(field, lit), F.lit(False))
    return F.lit(False)


def array_contains(field: Column, value) -> Column:
    """`contains` on a list."""
    return F.coalesce(F.array_contains(field, value), F.lit(False))


def metadata_filter(results: DataFrame, filters: Sequence[tuple[str, str, object]], k: int) -> DataFrame:
    """Keep results that meet all filters, then the first k. Filters come after the search's limit, which is part of the meaning."""
    for name, op, value in filters:
        keep = predicate(F.col(name), op, value) if name in results.columns else F.lit(op == "ne")
        results = results.where(keep)
    return top(results, k, "rank")


def vector_score(distance: Column | str = "distance") -> Column:
    """1 at distance 0, 0 at distance 2 and beyond."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d / 2))


def age_days(created: Column | str, as_of: str) -> Column:
    """Whole days of 24 hours, rounded down; parts of a second count."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = micros(F.lit(as_of)) - micros(F.col(created) if isinstance(created, str) else created)
    return F.floor(age / 86_400_000_000)


def recency(created: Column | str, as_of: str, half_life: float = 30.0) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.pow(F.lit(2.0), -age_days(created, as_of) / half_life)), F.lit(0.0))


def field_boost(boosts: dict[str, tuple[object, float]], types: dict[str, str]) -> Column:
    """Boosts of the fields that match, as a share of all boosts; lists match if they hold the value."""
    if not boosts:
        return F.lit(0.0)
    total = sum(w for _, w in boosts.values())
    hits = [F.when(array_contains(F.col(n), v) if types[n].startswith("array") else F.col(n).eqNullSafe(F.lit(v)), w).otherwise(0.0) for n, (v, w) in boosts.items()]
    out = hits[0]
    for h in hits[1:]:
        out = out + h
    return F.least(F.lit(1.0), out / total) if total else F.lit(0.0)


def metadata_score(parts: Sequence[Column], normalize: bool = True) -> Column:
    """The mean (or sum) of the boosts in use, at most 1."""
    if not parts:
        return F.lit(0.0)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(1.0), total / len(parts) if normalize else total)


def hybrid(results: DataFrame, meta: Column, k: int, vector_weight: float = 0.7, metadata_weight: float = 0.3) -> DataFrame:
    """Add vector_score, metadata_score and score; ties keep the order of distance."""
    if not (0 <= vector_weight <= 1 and 0 <= metadata_weight <= 1 and abs(vector_weight + metadata_weight - 1) <= 0.01):
        raise ValueError("weights must be in [0, 1] and sum to 1")
    scored = results.withColumn("vector_score", F.round(vector_score(), PLACES + 1)).withColumn("metadata_score", F.round(meta, PLACES))
    scored = scored.withColumn("score", F.round(vector_weight * vector_score() + metadata_weight * meta, PLACES)).withColumnRenamed("rank", "old_rank")
    return top(scored, k, F.desc("score"), "old_rank")


Boost = Callable[[Column], Column]


def boost_by_recency(as_of: str, half_life: float = 30.0) -> Boost:
    return lambda s: 0.7 * s + 0.3 * F.pow(F.lit(2.0), -age_days("created_at", as_of) / half_life)


def boost_by_position(prefer_early: bool = True) -> Boost:
    p = F.least(F.lit(1.0), F.col("chunk_index") / 100)
    return lambda s: 0.8 * s + 0.2 * (1 - p if prefer_early else p)


def boost_by_length(prefer_longer: bool = True) -> Boost:
    n = F.least(F.lit(1.0), F.length("text") / 5000)
    return lambda s: 0.85 * s + 0.15 * (n if prefer_longer else 1 - n)


def rerank(results: DataFrame, boost: Boost, k: int) -> DataFrame:
    """Rank by a function of 1 - distance / 2 and the row; ties keep the old order."""
    scored = results.withColumn("score", F.round(boost(1 - F.col("distance") / 2), PLACES)).withColumnRenamed("rank", "old_rank")
    return top(scored, k, F.desc("score"), "old_rank")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def keyword_rerank(results: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """Similarity, word overlap with the query, and place in the document."""
    q = words(query)
    overlap = F.size(F.array_intersect(q, words(F.col("text")))) / F.greatest(F.size(q), F.lit(1))
    score = 0.4 * (1 - F.col("distance") / 2) + 0.4 * overlap + 0.2 / (F.col("chunk_index") + 1)
    return top(results.withColumn("score", F.round(score, PLACES)).withColumnRenamed("rank", "old_rank"), k, F.desc("score"), "old_rank")


#: Abbreviations that queries have spelt out, in this order.
ABBREVIATIONS = (
    (" ML ", " machine learning "),
    (" AI ", " artificial intelligence "),
    (" NLP ", " natural language processing "),
    (" DL ", " deep learning "),
    (" CNN ", " convolutional neural network "),
    (" RNN ", " recurrent neural network "),
)


def preprocessed(query: Column) -> Column:
    """Blanks collapsed, odd characters out, abbreviations spelt out between blanks."""
    q = F.regexp_replace(F.trim(F.regexp_replace(query, r"\s+", " ")), r"(?U)[^\w\s?.!]", "")
    for short, full in ABBREVIATIONS:
        q = F.replace(q, F.lit(short), F.lit(full))
    return q


def context(results: DataFrame, limit: int = 500) -> DataFrame:
    """(query_id, context, n_sources, top_relevance): texts by rank, cut at `limit` characters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), "\n\n")
    out = results.groupBy("query_id").agg(joined.alias("all"), F.count("*").alias("n_sources"), F.round(F.max(1 - F.col("distance")), PLACES).alias("top_relevance"))
    return out.select("query_id", F.when(F.length("all") > limit, F.concat(F.substring("all", 1, limit), F.lit("..."))).otherwise(F.col("all")).alias("context"), "n_sources", "top_relevance")

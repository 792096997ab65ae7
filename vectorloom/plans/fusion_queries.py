"""F: rank fusion, expansion, sampling and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectorloom.operators import fusion, search
from vectorloom.sources.shared import written

from .registry import query, table
from .sql import query_vectors, results, results_sql

#: Three strategies over the same queries: the nearest, the longest texts and the newest of the 30 nearest.
RESULTS = f"""{results_sql(30)},
runs AS (SELECT 'vector' AS strategy, query_id, vec_id, round(1 - distance / 2, 7) AS score, rank - 1 AS place FROM results WHERE rank <= 15
UNION ALL SELECT 'keyword', query_id, vec_id, least(n_chars / 5000, 1.0), row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, vec_id) - 1 AS place FROM results QUALIFY place < 15
UNION ALL SELECT 'recent', query_id, vec_id, (vec_id % 100) / 100, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, vec_id) - 1 AS place FROM results QUALIFY place < 15)"""
W = "CASE strategy WHEN 'vector' THEN 0.7 WHEN 'keyword' THEN 0.3 WHEN 'metadata' THEN 0.2 ELSE 0.5 END"


def fused_sql(score: str, extra: str = "", places: int = 6) -> str:
    return f"WITH {RESULTS}, f AS (SELECT query_id, vec_id, round({score}::DOUBLE, {places}) AS score FROM runs GROUP BY query_id, vec_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank{extra} FROM f"


def runs(spark, sf_dir):
    r = written(results(spark, sf_dir, 30), "results")  # three runs use it
    place = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1
    cut = lambda name, score, p: r.select(F.lit(name).alias("strategy"), "query_id", "vec_id", score.alias("score"), p.alias("place")).where("place < 15")
    return (
        cut("vector", F.round(1 - F.col("distance") / 2, 7), F.col("rank") - 1)
        .unionByName(cut("keyword", F.least(F.col("n_chars") / 5000, F.lit(1.0)), place(F.desc("n_chars"), "vec_id")))
        .unionByName(cut("recent", (F.col("vec_id") % 100) / 100, place(F.desc("created_at"), "vec_id")))
    )


@query(fused_sql(f"sum({W} / (60 + place + 1))"))
def f1_rrf_fusion(spark, sf_dir):
    return fusion.rrf(runs(spark, sf_dir))


@query(fused_sql(f"sum({W} * score)", places=8))
def f2_linear_fusion(spark, sf_dir):
    return fusion.linear(runs(spark, sf_dir))


@query(f"WITH {RESULTS}, s AS (SELECT query_id, strategy, list(DISTINCT vec_id) AS ids FROM runs WHERE place < 10 GROUP BY ALL) SELECT a.query_id, round(avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))), 6) AS confidence FROM s a JOIN s b ON a.query_id = b.query_id AND a.strategy < b.strategy GROUP BY a.query_id")
def f3_fusion_confidence(spark, sf_dir):
    return fusion.confidence(runs(spark, sf_dir))


@query(fused_sql(f"sum({W} / (60 + place + 1))", ", 'learned' AS method"))
def f4_fuse_learned(spark, sf_dir):
    """Unknown methods fuse by reciprocal ranks and are reported as asked."""
    return fusion.fuse(runs(spark, sf_dir), "learned")


QUERIES = "q AS (SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN 'python search tutorial' WHEN 1 THEN 'Database example for AI' WHEN 2 THEN 'car scar guide' ELSE 'plain words' END || ' ' || lang AS query FROM documents)"


def _pairs(d: dict) -> str:
    return ", ".join(f"('{k}', {i}, '{v}')" for k, vs in d.items() for i, v in enumerate(vs))


def expansion_sql(strategy: str, most: int = 5) -> str:
    part = lambda n, entries, w, kind, c: f"SELECT query_id, {n} AS part, p AS a, i AS b, replace(lower(query), w, t) AS text, {w} AS weight, '{kind}' AS kind, {c} AS confidence FROM words JOIN (VALUES {_pairs(entries)}) d(k, i, t) ON k = w WHERE replace(lower(query), w, t) <> lower(query)"
    parts = ["SELECT query_id, 0 AS part, 0 AS a, 0 AS b, query AS text, 1.0 AS weight, 'original' AS kind, 1.0 AS confidence FROM q", part(1, fusion.SYNONYMS, 0.8, "synonym", 0.9)]
    if strategy != "conservative":
        parts.append(part(2, fusion.SPECIFIC, 0.7, "specific", 0.7))
    if strategy == "aggressive":
        forms = ["'how to ' || query", "query || ' guide'", "query || ' tutorial'", "'learn ' || query"]
        parts += [f"SELECT query_id, 3, {i}, 0, {f}, 0.6, 'paraphrase', 0.6 FROM q" for i, f in enumerate(forms)]
    return f"WITH {QUERIES}, words AS (SELECT query_id, query, unnest(string_split(lower(query), ' ')) AS w, unnest(range(20)) AS p FROM q), e AS ({' UNION ALL '.join(parts)}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, a, b) - 1 AS pos, text, weight, kind, confidence FROM e QUALIFY pos <= {most}"


def expansion(spark, sf_dir, strategy):
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, "python search tutorial").when(kind == 1, "Database example for AI").when(kind == 2, "car scar guide").otherwise("plain words")
    return fusion.expanded(d.select(F.col("doc_id").alias("query_id"), F.concat(text, F.lit(" "), "lang").alias("query")), strategy)


@query(expansion_sql("conservative"))
def f5_expand_conservative(spark, sf_dir):
    return expansion(spark, sf_dir, "conservative")


@query(expansion_sql("balanced"))
def f5_expand_balanced(spark, sf_dir):
    return expansion(spark, sf_dir, "balanced")


@query(expansion_sql("aggressive"))
def f6_expand_aggressive(spark, sf_dir):
    return expansion(spark, sf_dir, "aggressive")


@query(fused_sql("sum(CASE strategy WHEN 'vector' THEN 1.0 WHEN 'keyword' THEN 0.8 ELSE 1.0 END / (60 + place + 1))"))
def f7_merge_rrf(spark, sf_dir):
    return fusion.rrf(runs(spark, sf_dir), {"vector": 1.0, "keyword": 0.8})


@query(fused_sql("max(CASE strategy WHEN 'vector' THEN 1.0 WHEN 'keyword' THEN 0.8 ELSE 1.0 END * score)"))
def f8_merge_weighted(spark, sf_dir):
    return fusion.best_of(runs(spark, sf_dir), {"vector": 1.0, "keyword": 0.8})


@query(f"WITH {RESULTS}, m AS (SELECT DISTINCT query_id, vec_id FROM runs), o AS (SELECT query_id, vec_id FROM runs WHERE strategy = 'vector') SELECT m.query_id, round(sum(CASE WHEN o.vec_id IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS improvement FROM m LEFT JOIN o USING (query_id, vec_id) GROUP BY m.query_id")
def f9_recall_improvement(spark, sf_dir):
    r = runs(spark, sf_dir)
    return fusion.recall_improvement(r.where("strategy = 'vector'"), r.select("query_id", "vec_id").distinct())


@query(f"WITH {results_sql(10)} SELECT query_id, vec_id, distance, rank FROM results")
def f10_temperature_zero(spark, sf_dir):
    return fusion.temperature_sample(results(spark, sf_dir, 50), 10, 0.0).select("query_id", "vec_id", "distance", "rank")


@query(f"""WITH {results_sql(50)}, u AS (SELECT *, (('0x' || substr(md5('42:' || query_id || ':' || vec_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM results),
drawn AS (SELECT query_id, vec_id, distance FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY -distance - ln(-ln(u)) DESC, vec_id) <= 10)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM drawn""")
def f10_temperature_sampling(spark, sf_dir):
    """Seeded draws; tests hold their distribution."""
    return fusion.temperature_sample(results(spark, sf_dir, 50), 10, 1.0).select("query_id", "vec_id", "distance", "rank")


@query(f"WITH {results_sql(10)} SELECT query_id, CASE WHEN count(*) < 2 THEN 0 ELSE round(least(var_pop(distance), 1.0), 4) END AS diversity FROM results GROUP BY query_id")
def f11_diversity(spark, sf_dir):
    return fusion.diversity(results(spark, sf_dir, 10))


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 0.0 WHEN 'view' THEN 1.0 WHEN 'signup' THEN 1.5 WHEN 'purchase' THEN 2.0 ELSE 1.0 END AS temperature FROM events")
def f12_recommended_temperature(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    names = {"click": "precision", "view": "balanced", "signup": "diversity", "purchase": "exploration"}
    use = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("other"))
    return fusion.temperature_for(e.withColumn("use", use), "use").drop("use")


FEEDBACK = "fb AS (SELECT event_id % 500 AS vec_id, sum(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.7 WHEN 'error' THEN -0.3 WHEN 'purchase' THEN 1.0 ELSE 0.5 END * (event_id % 11) / 10.0 * 0.1) AS boost FROM events GROUP BY 1)"


@query(f"WITH {results_sql(10)}, {FEEDBACK}, s AS (SELECT query_id, vec_id, rank AS old_rank, round((1 - distance / 2) * (1 + coalesce(boost, 0)), 6) AS score FROM results LEFT JOIN fb USING (vec_id)) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM s")
def f13_feedback_rerank(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("click", "click", "view", "dwell", "error", "skip", "purchase", "bookmark", "signup", "other")])
    fb = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("vec_id"), names[F.col("event_type")].alias("signal"), ((F.col("event_id") % 11) / 10).alias("strength"))
    r = results(spark, sf_dir, 10).withColumn("score", 1 - F.col("distance") / 2)
    return fusion.feedback_rerank(r, fb).select("query_id", "vec_id", "score", "rank")


@query()
def f14_search_replay(spark, sf_dir):
    """What the graph search visited, skipped and where it stopped, a row for each query."""
    e = table(spark, sf_dir, "embeddings")
    steps = search.graph_knn(search.build_graph(e), query_vectors(e), 10, trace=True)
    n = lambda a: F.sum((F.col("action") == a).cast("int")).alias(f"{a}s")
    return steps.groupBy("query_id").agg(F.count("*").alias("steps"), n("entry"), n("visit"), n("skip"), F.countDistinct("shard").alias("shards"))

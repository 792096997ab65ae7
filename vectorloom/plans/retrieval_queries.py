"""Q: what follows a search."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions.embed import hash_embedding
from vectorloom.operators import retrieval as R
from vectorloom.operators import search

from .registry import query, table
from .sql import AS_OF, EVERY, query_vectors, results, results_sql

AGE = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400)"
RECENCY = f"least(1.0, pow(2.0, -{AGE} / 30.0))"
VS = "least(1.0, greatest(0.0, 1 - distance / 2))"
WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"


def best(k: int, by: str = "score DESC, old_rank") -> str:
    return f"row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS rank FROM scored QUALIFY rank <= {k}"


def _scored(df, *extra):
    return df.select("query_id", "vec_id", "score", *extra, "rank")


@query(f"WITH {results_sql(10)} SELECT query_id, vec_id, distance, rank, chunk_index, length(text) AS text_length FROM results")
def q1_search_with_embedding(spark, sf_dir):
    return results(spark, sf_dir, 10).select("query_id", "vec_id", "distance", "rank", "chunk_index", F.length("text").alias("text_length"))


def hashed_sql(source: str, ident: str) -> str:
    """md5 embeddings in SQL, of 64 places."""
    return f"""t AS (SELECT {ident} AS id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM {source}),
p AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM t GROUP BY ALL),
n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM p GROUP BY id)"""


@query(f"WITH d AS (SELECT doc_id, text FROM documents), {hashed_sql('d', 'doc_id')}, e AS (SELECT id, pos, v / norm AS v FROM p JOIN n USING (id) WHERE norm > 0), s AS (SELECT q.id AS query_id, c.id AS vec_id, round(1 - sum(q.v * c.v), 6) + 0.0 AS distance FROM e q JOIN e c USING (pos) WHERE q.id % {EVERY} = 0 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 5")
def q2_search_with_text(spark, sf_dir):
    """Texts and queries embedded by hashed words; texts without words are left out."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), hash_embedding(F.col("text")).alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    return search.knn(d, query_vectors(d), 5)


@query(f"WITH {results_sql(100)}, scored AS (SELECT *, rank AS old_rank FROM results WHERE label >= 3 AND lang = 'en') SELECT query_id, vec_id, distance, {best(10, 'old_rank').replace(' FROM scored', ' FROM (SELECT * EXCLUDE (rank) FROM scored)')}")
def q3_metadata_filter(spark, sf_dir):
    r = R.metadata_filter(results(spark, sf_dir, min(10 * 10, 1000)), [("label", "gte", 3), ("lang", "eq", "en")], 10)
    return r.select("query_id", "vec_id", "distance", "rank")


@query("WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n, string_split(source, 'c') AS tags FROM documents) SELECT doc_id, lang IS NOT DISTINCT FROM 'en' AS eq, lang IS DISTINCT FROM 'en' AS ne, coalesce(n > 1000, false) AS gt, coalesce(n < 1000, false) AS lt, coalesce(n >= 500, false) AS gte, coalesce(n <= 500, false) AS lte, coalesce(lang IN ('en', 'de'), false) AS is_in, coalesce(contains(lang, 'e'), false) AS has, list_contains(tags, '1') AS has_tag, false AS unknown FROM f")
def q4_predicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("n"), F.split("source", "c").alias("tags"))
    lang, n = F.col("lang"), F.col("n")
    cases = {"eq": (lang, "eq", "en"), "ne": (lang, "ne", "en"), "gt": (n, "gt", 1000), "lt": (n, "lt", 1000), "gte": (n, "gte", 500), "lte": (n, "lte", 500), "is_in": (lang, "in", ["en", "de"]), "has": (lang, "contains", "e"), "unknown": (lang, "like", "e")}
    return d.select("doc_id", *[R.predicate(*c).alias(k) for k, c in cases.items()], R.array_contains(F.col("tags"), "1").alias("has_tag"))


@query(f"WITH {results_sql(50)}, scored AS (SELECT * EXCLUDE (rank), rank AS old_rank, round({VS}, 7) AS vector_score, round({RECENCY}, 6) AS metadata_score, round(0.7 * {VS} + 0.3 * {RECENCY}, 6) AS score FROM results) SELECT query_id, vec_id, score, vector_score, metadata_score, {best(10)}")
def q5_hybrid_search(spark, sf_dir):
    r = results(spark, sf_dir, min(5 * 10, 500))
    return _scored(R.hybrid(r, R.metadata_score([R.recency("created_at", AS_OF)]), 10), "vector_score", "metadata_score")


@query(f"WITH {results_sql(50)}, m AS (SELECT *, least(1.0, ({RECENCY} + CASE WHEN label = 3 THEN 2.0 ELSE 0 END / 2.0) / 2) AS meta FROM results), scored AS (SELECT * EXCLUDE (rank), rank AS old_rank, round(0.6 * {VS} + 0.4 * meta, 6) AS score, round(meta, 6) AS metadata_score FROM m) SELECT query_id, vec_id, score, metadata_score, {best(10)}")
def q6_metadata_score(spark, sf_dir):
    r = results(spark, sf_dir, 50)
    boost = R.field_boost({"label": (3, 2.0)}, dict(r.dtypes))
    return _scored(R.hybrid(r, R.metadata_score([R.recency("created_at", AS_OF), boost]), 10, 0.6, 0.4), "metadata_score")


@query("SELECT doc_id, round(least(1.0, (CASE WHEN lang = 'en' THEN 2.0 ELSE 0 END + CASE WHEN source = 'src1' THEN 1.0 ELSE 0 END + CASE WHEN list_contains(string_split(source, 'c'), '2') THEN 0.5 ELSE 0 END) / 3.5), 6) AS boost FROM documents")
def q7_field_boost(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("tags", F.split("source", "c"))
    return d.select("doc_id", F.round(R.field_boost({"lang": ("en", 2.0), "source": ("src1", 1.0), "tags": ("2", 0.5)}, dict(d.dtypes)), 6).alias("boost"))


@query(f"SELECT event_id, floor((epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400)::BIGINT AS days, round(least(1.0, pow(2.0, -floor((epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400) / 7.0)), 6) AS boost FROM events")
def q8_recency_boost(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.age_days("ts", "2024-02-01").alias("days"), F.round(R.recency("ts", "2024-02-01", 7.0), 6).alias("boost"))


def rerank_sql(score: str) -> str:
    return f"WITH {results_sql(30)}, scored AS (SELECT * EXCLUDE (rank), rank AS old_rank, round({score}, 6) AS score FROM results) SELECT query_id, vec_id, score, {best(10)}"


def reranked(spark, sf_dir, boost):
    return _scored(R.rerank(results(spark, sf_dir, min(3 * 10, 300)), boost, 10))


@query(rerank_sql(f"0.7 * (1 - distance / 2) + 0.3 * pow(2.0, -{AGE} / 30.0)"))
def q9_search_with_reranking(spark, sf_dir):
    return reranked(spark, sf_dir, R.boost_by_recency(AS_OF))


@query(rerank_sql(f"0.7 * (1 - distance / 2) + 0.3 * pow(2.0, -{AGE} / 10.0)"))
def q10_rerank_recency(spark, sf_dir):
    return reranked(spark, sf_dir, R.boost_by_recency(AS_OF, 10.0))


@query(rerank_sql("0.8 * (1 - distance / 2) + 0.2 * (1 - least(1.0, chunk_index / 100))"))
def q11_rerank_position(spark, sf_dir):
    return reranked(spark, sf_dir, R.boost_by_position())


@query(rerank_sql("0.8 * (1 - distance / 2) + 0.2 * least(1.0, chunk_index / 100)"))
def q11_rerank_late_position(spark, sf_dir):
    return reranked(spark, sf_dir, R.boost_by_position(False))


@query(rerank_sql("0.85 * (1 - distance / 2) + 0.15 * least(1.0, length(text) / 5000)"))
def q12_rerank_length(spark, sf_dir):
    return reranked(spark, sf_dir, R.boost_by_length())


@query(rerank_sql("0.85 * (1 - distance / 2) + 0.15 * (1 - least(1.0, length(text) / 5000))"))
def q12_rerank_short(spark, sf_dir):
    return reranked(spark, sf_dir, R.boost_by_length(False))


@query(f"WITH {results_sql(10)} SELECT query_id, rank, vec_id AS chunk_id, 'doc-' || vec_id AS document_id, source AS title, text, distance FROM results")
def q13_result_projection(spark, sf_dir):
    """The slim response: embeddings stay out."""
    return results(spark, sf_dir, 10).select("query_id", "rank", F.col("vec_id").alias("chunk_id"), F.concat(F.lit("doc-"), "vec_id").alias("document_id"), F.col("source").alias("title"), "text", "distance")


@query(f"WITH {results_sql(10)}, q AS (SELECT doc_id AS query_id, text AS query FROM documents), m AS (SELECT r.*, {WORDS.format('query')} AS qw, {WORDS.format('text')} AS tw FROM results r JOIN q USING (query_id)), scored AS (SELECT * EXCLUDE (rank), rank AS old_rank, round(0.4 * (1 - distance / 2) + 0.4 * (len(list_intersect(qw, tw)) / greatest(len(qw), 1)) + 0.2 / (chunk_index + 1), 6) AS score FROM m) SELECT query_id, vec_id, score, {best(5)}")
def q14_keyword_rerank(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return _scored(R.keyword_rerank(results(spark, sf_dir, 10).join(q, "query_id"), F.col("query"), 5))


@query(r"WITH q AS (SELECT conv_id, turn, trim(regexp_replace('the ML, and AI; of ' || text || '  with NLP (too) !', '[\s]+', ' ', 'g')) AS s FROM conversations), r AS (SELECT conv_id, turn, regexp_replace(s, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s?.!]', '', 'g') AS s FROM q) SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(s, ' ML ', ' machine learning '), ' AI ', ' artificial intelligence '), ' NLP ', ' natural language processing '), ' DL ', ' deep learning '), ' CNN ', ' convolutional neural network '), ' RNN ', ' recurrent neural network ') AS query FROM r")
def q15_query_preprocessing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", R.preprocessed(F.concat(F.lit("the ML, and AI; of "), "text", F.lit("  with NLP (too) !"))).alias("query"))


@query(f"WITH {results_sql(5)}, g AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS a, count(*) AS n_sources, round(max(1 - distance), 6) AS top_relevance FROM results GROUP BY query_id) SELECT query_id, CASE WHEN length(a) > 500 THEN substr(a, 1, 500) || '...' ELSE a END AS context, n_sources, top_relevance FROM g")
def q16_context_assembly(spark, sf_dir):
    return R.context(results(spark, sf_dir, 5))


@query(f"WITH {results_sql(10)} SELECT query_id, vec_id, rank, round(1 - distance, 6) AS relevance, source AS document_title, lang FROM results")
def q17_rag_retrieve(spark, sf_dir):
    return results(spark, sf_dir, 10).select("query_id", "vec_id", "rank", F.round(1 - F.col("distance"), 6).alias("relevance"), F.col("source").alias("document_title"), "lang")

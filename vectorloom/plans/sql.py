"""Pieces of SQL, and the tables that stand for chunks and results in the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import search

from .registry import table

AS_OF = "2024-03-01"
#: The queries of a search: every row whose id is divisible by this.
EVERY = 100


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def unit(a: str) -> str:
    return f"list_transform({a}, lambda x: x::DOUBLE / {norm(a)})"


UNITS = f"units AS (SELECT vec_id, label, embedding, {unit('embedding')} AS u FROM embeddings)"
CHUNKS = f"""chunks AS (SELECT e.vec_id, e.embedding, e.label, e.vec_id % 10 AS chunk_index, TIMESTAMP '2024-01-01' + to_hours(e.vec_id) AS created_at,
  d.text, d.lang, d.source, d.n_chars, {unit('e.embedding')} AS u FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


def results_sql(k: int, of: str = "chunks") -> str:
    """CTEs ending in results(query_id, vec_id, distance, rank, ...)."""
    start = CHUNKS if of == "chunks" else UNITS
    return f"""{start},
pairs AS (SELECT q.vec_id AS query_id, c.*, round(1 - list_dot_product(q.u, c.u), 6) + 0.0 AS distance FROM {of} q, {of} c WHERE q.vec_id % {EVERY} = 0),
results AS (SELECT * EXCLUDE (embedding, u) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= {k})"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600)
    return e.join(d, e["vec_id"] == d["doc_id"]).select("vec_id", "embedding", "label", (F.col("vec_id") % 10).alias("chunk_index"), created.alias("created_at"), "text", "lang", "source", "n_chars")


def query_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def results(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The exact neighbours of the query vectors, with their chunks' columns."""
    c = chunks(spark, sf_dir)
    return search.knn(c, query_vectors(c), k).join(c.drop("embedding"), "vec_id")

"""S: corpora, documents, ingestion, export and the operation log, as transformations of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.functions.embed import embedded, hash_embedding, hashed
from vectorloom.sources import catalog as C
from vectorloom.sources.shared import fresh_path, written

from .registry import query, table
from .retrieval_queries import hashed_sql

DIM = 64
#: Whole texts: of ten documents one is a single chunk, however long, and the others are cut into chunks of the length that is allowed.
CUT = f"list_transform(range(greatest(1, (length(text) + {C.MOST_CHARS - 1}) // {C.MOST_CHARS})), lambda k: substr(text, k * {C.MOST_CHARS} + 1, {C.MOST_CHARS}))"
BATCH = f"b AS (SELECT doc_id AS idx, CASE WHEN doc_id % 10 = 5 THEN [''] WHEN doc_id % 10 = 7 THEN [coalesce(text, '')] ELSE {CUT.replace('text', "coalesce(text, '')")} END AS chunks FROM documents JOIN embeddings ON vec_id = doc_id)"
ERROR = f"CASE WHEN idx % 10 = 6 THEN 'number of chunks' WHEN len(list_filter(chunks, lambda c: length(c) NOT BETWEEN 1 AND {C.MOST_CHARS})) > 0 THEN 'text length' WHEN idx % 10 IN (3, 4) THEN 'embedding' END"
NO_FIELDS = {"title": "string", "author": "string", "document_type": "string", "source_url": "string", "tags": "array<string>"}


def batch(spark, sf_dir):
    """Documents with their vectors; of each ten, one has a short vector, one a zero vector, one an empty text, one no chunks and one a single chunk."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    i, v, text = F.col("doc_id") % 10, F.col("embedding"), F.coalesce("text", F.lit(""))
    vector = F.when(i == 3, F.slice(v, 1, 10)).when(i == 4, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v)
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / C.MOST_CHARS).cast("int") - 1)
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * C.MOST_CHARS + 1, F.lit(C.MOST_CHARS)))
    pieces = F.when(i == 5, F.array(F.lit(""))).when(i == 7, F.array(text)).otherwise(pieces)
    chunks = F.transform(pieces, lambda t: F.struct(t.alias("text"), vector.alias("embedding")))
    chunks = F.when(i == 6, F.slice(chunks, 1, 0)).otherwise(chunks)
    return d.join(e, d["doc_id"] == e["vec_id"]).select(F.col("doc_id").alias("idx"), F.concat(F.lit("doc-"), "doc_id").alias("document_id"), *[F.lit(None).cast(k).alias(c) for c, k in NO_FIELDS.items()], chunks.alias("chunks"))


def catalog(spark, sf_dir, *, with_documents: bool = False):
    """A catalog of its own with a corpus for each source, and each conversation a document of one of them."""
    cat = C.Catalog(spark, fresh_path(spark, "catalog"))
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    made = cat.create_corpora(sources.withColumn("embedding_dimension", F.lit(DIM)))
    if with_documents:
        c = table(spark, sf_dir, "conversations")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("array<float>").alias("embedding")))
        docs = c.groupBy("conv_id").agg(texts.alias("chunks")).withColumn("name", F.concat(F.lit("src"), (F.col("conv_id") % 3).cast("string")))
        docs = docs.join(made, "name").select(F.col("conv_id").alias("idx"), F.col("conv_id").cast("string").alias("document_id"), "corpus_id", *[F.lit(None).cast(k).alias(c) for c, k in NO_FIELDS.items()], "chunks")
        cat.add_documents(None, docs, hash_embedding)
    return cat


#: Conversations whose chunks all have a word to embed, in the corpora that there are.
DOCS = """docs AS (SELECT c.conv_id, 'src' || c.conv_id % 3 AS name, count(*) AS chunks FROM conversations c WHERE 'src' || c.conv_id % 3 IN (SELECT source FROM documents)
  GROUP BY ALL HAVING bool_and(regexp_matches(lower(text), '[a-z0-9]') AND length(text) <= 10000))"""


@query("SELECT source AS name, 'brute_force' AS index_type, 64 AS embedding_dimension, 0 AS num_documents FROM documents GROUP BY source")
def s1_create_corpora(spark, sf_dir):
    return catalog(spark, sf_dir).list_corpora().select("name", "index_type", "embedding_dimension", "num_documents")


@query(f"WITH {DOCS} SELECT source AS name, count(conv_id) AS num_documents FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src0') LEFT JOIN docs ON name = source GROUP BY source")
def s2_list_corpora(spark, sf_dir):
    """The list after one corpus was deleted, with what was in it."""
    cat = catalog(spark, sf_dir, with_documents=True)
    cat.delete_corpus(cat.corpora().where("name = 'src0'").first()["corpus_id"])
    return cat.list_corpora().select("name", "num_documents")


@query(f"WITH {DOCS} SELECT conv_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, text, 1.0 AS norm FROM conversations SEMI JOIN docs USING (conv_id)")
def s3_add_document_from_texts(spark, sf_dir):
    """Chunks as stored: numbered, embedded and normalised."""
    return catalog(spark, sf_dir, with_documents=True).chunks().select("document_id", "chunk_index", "text", F.round(V.norm("embedding"), 5).alias("norm"))


@query(f"WITH {BATCH} SELECT 'doc-' || idx AS document_id, unnest(range(len(chunks))) AS chunk_index, length(unnest(chunks)) AS n FROM b WHERE {ERROR} IS NULL")
def s4_add_document_with_embeddings(spark, sf_dir):
    good, _ = C.checked_batch(batch(spark, sf_dir), DIM)
    return good.select("document_id", F.posexplode("chunks").alias("chunk_index", "c")).select("document_id", "chunk_index", F.length("c.text").alias("n"))


@query(f"WITH {BATCH} SELECT idx, {ERROR} AS error FROM b WHERE {ERROR} IS NOT NULL")
def s5_batch_failures(spark, sf_dir):
    return C.checked_batch(batch(spark, sf_dir), DIM)[1]


@query(f"WITH {BATCH} SELECT coalesce({ERROR}, 'added') AS outcome, count(*) AS n FROM b GROUP BY 1")
def s6_batch_add_with_embeddings(spark, sf_dir):
    good, bad = C.checked_batch(batch(spark, sf_dir), DIM)
    return good.select(F.lit("added").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS}, ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 0 UNION ALL SELECT DISTINCT -1 - conv_id FROM conversations WHERE conv_id % 7 = 1) SELECT conv_id::VARCHAR AS document_id, CASE WHEN d.conv_id IS NULL THEN 'Document not found' ELSE 'deleted' END AS outcome FROM ids LEFT JOIN docs d USING (conv_id)")
def s7_batch_delete(spark, sf_dir):
    """Every seventh document goes, and as many unknown ids are reported."""
    cat, c = catalog(spark, sf_dir, with_documents=True), table(spark, sf_dir, "conversations").select("conv_id").distinct()
    ids = c.where("conv_id % 7 = 0").unionByName(c.where("conv_id % 7 = 1").select((-1 - F.col("conv_id")).alias("conv_id"))).select(F.col("conv_id").cast("string").alias("document_id"))
    before = written(cat.documents().select("document_id"), "before")
    missing = cat.delete_documents(ids).select("document_id", F.col("error").alias("outcome"))
    gone = before.join(cat.documents().select("document_id"), "document_id", "left_anti").withColumn("outcome", F.lit("deleted"))
    return gone.unionByName(missing)


@query("SELECT CASE doc_id % 5 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'title is missing' WHEN 3 THEN 'texts are missing' ELSE 'ok' END AS outcome, count(*) AS n FROM documents WHERE doc_id % 5 <> 4 GROUP BY 1")
def s8_ndjson_ingest(spark, sf_dir):
    """Of each five lines one is good, three are bad in their ways, one is blank."""
    d = table(spark, sf_dir, "documents")
    good = F.to_json(F.struct(F.col("source").alias("title"), F.array("text", "lang").alias("texts")))
    line = F.when(F.col("doc_id") % 5 == 0, good).when(F.col("doc_id") % 5 == 1, '{"title": "cut').when(F.col("doc_id") % 5 == 2, F.to_json(F.struct(F.array("lang").alias("texts")))).when(F.col("doc_id") % 5 == 3, '{"title": "t", "texts": []}').otherwise("  ")
    return C.parse_ndjson(d.select(line.alias("value"))).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS document_id, count(*) AS n_chunks, list(text ORDER BY turn)[1] AS first_text FROM conversations GROUP BY conv_id")
def s9_export(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("turn").alias("chunk_id"), "text")
    out = C.exported(c.select("document_id").distinct(), c)
    return out.select("document_id", "n_chunks", F.get_json_object("json", "$.chunks[0].text").alias("first_text"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN true ELSE false END AS corrupt FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' OR o_orderkey % 7 = 0")
def s10_log_truncation(spark, sf_dir):
    """Entries before a time go; lines that can't be read stay."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 7 == 0, "{").alias("_corrupt_record"))
    return C.truncated(o, "1997-01-01").select("key", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("WITH log AS (SELECT l_orderkey AS key, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 'add_document' ELSE 'delete_document' END AS op FROM lineitem), last AS (SELECT key, max(l_linenumber) AS n FROM log GROUP BY key) SELECT DISTINCT key FROM last WHERE n % 2 = 1")
def s12_replay_log(spark, sf_dir):
    """What the log's adds and deletes leave."""
    li = table(spark, sf_dir, "lineitem")
    op = F.when(F.col("l_linenumber") % 2 == 1, "add_document").otherwise("delete_document")
    return C.replayed(li.select(F.col("l_orderkey").alias("key"), op.alias("operation"), F.timestamp_seconds("l_linenumber").alias("ts")))


def _embedder(dimension: int):
    return lambda texts, kind: [hashed(t, dimension) for t in texts]


@query(f"""WITH d AS (SELECT doc_id, text FROM documents), {hashed_sql('d', 'doc_id')}, s AS (SELECT id, sum(v * v) FILTER (pos < 32) AS square FROM p GROUP BY id),
r AS (SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 524288 THEN 'text is too long' WHEN coalesce(square, 0) = 0 THEN 'zero norm' END AS error FROM d LEFT JOIN s ON id = doc_id)
SELECT *, CASE WHEN error IS NULL THEN 32 END AS dims, CASE WHEN error IS NULL THEN 1.0 END AS norm FROM r""")
def s13_embedding_connector(spark, sf_dir):
    """Texts through the connector: batches of 96, vectors cut to 32 places and normalised again, failures row by row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = embedded(rows, _embedder(64), 32)
    return out.select("doc_id", "error", F.when(F.col("error").isNull(), F.size("embedding")).alias("dims"), F.round(V.norm("embedding"), 5).alias("norm"))


@query(f"WITH {DOCS} SELECT 'brute_force' AS old_type, 'ivf' AS new_type, (SELECT sum(chunks)::BIGINT FROM docs WHERE name = 'src1') AS vectors")
def i10_switch_index(spark, sf_dir):
    """A corpus's index type is switched: old and new, and the vectors to index."""
    cat = catalog(spark, sf_dir, with_documents=True)
    old, new, n = cat.set_index(cat.corpora().where("name = 'src1'").first()["corpus_id"], "ivf")
    return spark.createDataFrame([(old, new, n)], "old_type string, new_type string, vectors long")

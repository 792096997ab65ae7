"""Invariants of operators that SQL can't express, and edge cases."""

import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import embed
from vectorloom.functions import vectors as V
from vectorloom.functions.embed import hash_embedding
from vectorloom.operators import analytics, fusion, retrieval, search
from vectorloom.operators import vectors as ops
from vectorloom.sources import catalog as C
from vectorloom.streaming import events as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")


def test_exact_search_finds_itself_first(corpus, queries):
    found = search.knn(corpus, queries, 5).toPandas()
    first = found[found["rank"] == 1]
    assert (first.query_id == first.vec_id).all() and (first.distance.abs() < 1e-5).all()
    assert (found.groupby("query_id").size() == 5).all()
    for _, g in found.sort_values("rank").groupby("query_id"):
        assert g.distance.is_monotonic_increasing


def test_blocks_of_queries_change_nothing(corpus, queries, monkeypatch):
    whole = search.knn(corpus, queries, 5).toPandas()
    monkeypatch.setattr(search, "BATCH", 7)
    monkeypatch.setattr(search, "SHARD", 90)
    parts = search.knn(corpus, queries, 5).toPandas()
    key = ["query_id", "rank"]
    assert whole.sort_values(key).values.tolist() == parts.sort_values(key).values.tolist()


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(corpus, queries, k):
    with pytest.raises(ValueError):
        search.knn(corpus, queries, k)


def test_empty_tables(spark, corpus, queries):
    assert search.knn(corpus.where("false"), queries, 3).count() == 0
    assert search.knn(corpus, queries.where("false"), 3).count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_graph_recall(corpus, queries, shards):
    exact = search.knn(corpus, queries, 10)
    found = search.graph_knn(search.build_graph(corpus, shard_count=shards), queries, 10)
    assert search.recall(found, exact).first()["recall"] >= 0.9


def test_graph_grows_and_shrinks(spark, corpus, queries):
    """Vectors that are added are found like those of the build; removed ones are not; wrong ids are told."""
    exact = search.knn(corpus, queries, 10)
    part = search.build_graph(corpus.where("vec_id % 3 <> 0"), shard_count=2)
    grown = search.add_to_graph(part, corpus.where("vec_id % 3 = 0"))
    assert grown.count() == corpus.count()
    assert search.recall(search.graph_knn(grown, queries, 10), exact).first()["recall"] >= 0.9
    with pytest.raises(ValueError):
        search.add_to_graph(grown, corpus.where("vec_id = 3"))
    left, missing = search.remove_from_graph(grown, spark.createDataFrame([(3,), (-7,)], "vec_id long"))
    assert [r[0] for r in missing.collect()] == [-7] and left.count() == corpus.count() - 1
    assert search.graph_knn(left, queries, 10).where("vec_id = 3").count() == 0
    stats = {r["layer"]: r for r in search.graph_statistics(grown).collect()}
    assert stats[0]["nodes"] == corpus.count() and stats[0]["most"] <= 2 * search.LINKS
    assert all(stats[i]["nodes"] < stats[i - 1]["nodes"] for i in range(1, len(stats))) and len(stats) > 1


def test_graph_search_lengthens_its_list(corpus, queries):
    """A list that is too short for the recall is doubled until it is reached."""
    exact, graph = search.knn(corpus, queries, 10), search.build_graph(corpus, m=2, candidates=4, shard_count=1)
    assert search.recall(search.graph_knn(graph, queries, 10, 10), exact).first()["recall"] < 0.9
    assert search.recall(search.tuned_graph_knn(graph, queries, exact, ef=10), exact).first()["recall"] >= 0.9


def test_graph_of_copies(spark, corpus, queries):
    """With 20 copies of each vector the graph is still one: it finds, grows and shrinks as without them."""
    copies = corpus.where("vec_id < 300").select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("c"), "vec_id", "embedding")
    many = copies.select((F.col("vec_id") + F.col("c") * 1000).alias("vec_id"), "embedding")
    graph = search.build_graph(many, shard_count=1)
    assert graph.count() == many.count() and search.graph_statistics(graph).where("layer = 0").first()["nodes"] == 300
    near = lambda g, e, k: search.recall(search.graph_knn(g, queries, k), search.knn(e, queries, k)).first()["recall"]
    assert near(graph, many, 50) >= 0.9
    gone = many.where("vec_id < 1000")
    left, missing = search.remove_from_graph(graph, gone.select("vec_id"))
    rest = many.where("vec_id >= 1000")
    assert left.count() == rest.count() and missing.count() == 0 and near(left, rest, 50) >= 0.9
    again = search.add_to_graph(left, gone)
    assert again.count() == many.count() and near(again, many, 50) >= 0.9


@pytest.mark.parametrize("leaf", [40, 1000])
def test_box_tree_is_exact(corpus, queries, leaf):
    tree = search.box_tree(corpus, leaf)
    want = search.knn(corpus, queries, 7).select("query_id", "vec_id", "distance", "rank").collect()
    got = search.tree_knn(tree, queries, 7).select("query_id", "vec_id", "distance", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    sizes = [r["n"] for r in search.boxes(tree).collect()]
    assert sum(sizes) == corpus.count() and max(sizes) <= 2 * leaf
    assert search.tree_knn(search.box_tree(corpus.where("false"), leaf), queries, 7).count() == 0


def test_box_tree_prunes_what_is_clustered(spark):
    """Far clusters are in leaves that a query does not ask: the second pass has no rows."""
    g = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[i % 4] * 10 + g.standard_normal(8) * 0.1).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = search.tree_knn(search.box_tree(df, 100), q, 5)
    assert got.where("query_id % 4 <> vec_id % 4").count() == 0 and got.count() == 20


def test_registered_searches_reach_their_recall(spark):
    """Planes and probes of the registered queries, on all queries of a larger table."""
    from vectorloom.plans import search_queries as S

    sf = "/root/testdata/sf0.01"
    exact = S.i1_knn_exact(spark, sf)
    for q in (S.i3_lsh_knn, S.i3_lsh_tuned, S.i4_graph_knn, S.i5_ivf_knn, S.i5_ivf_trained, S.i5_ivf_quantized):
        assert search.recall(q(spark, sf), exact).first()["recall"] >= 0.9, q.__name__


def test_product_quantization_against_brute_force(corpus):
    """Codes are the nearest centroids, and what they stand for is near the vectors."""
    books = search.pq_codebooks(corpus, 8, 16)
    b = search._codebook_array(books)
    assert b.shape[0] == 8 and b.shape[2] == 8 and b.shape[1] <= 16
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in corpus.collect()}
    codes = {r["vec_id"]: r["codes"] for r in search.pq_encoded(corpus, books).collect()}
    back = {r["vec_id"]: np.array(r["embedding"]) for r in search.pq_decoded(search.pq_encoded(corpus, books), books).collect()}
    for i, v in rows.items():
        v = v / np.linalg.norm(v)
        d = ((b - v.reshape(8, 1, 8)) ** 2).sum(2)
        assert np.allclose(d[np.arange(8), codes[i]], d.min(1)) and np.allclose(back[i], np.concatenate([b[s, c] for s, c in enumerate(codes[i])]))
    assert np.mean([np.linalg.norm(back[i] - v / np.linalg.norm(v)) for i, v in rows.items()]) < 0.75


def test_hot_lists_are_dealt_to_shards(corpus, queries, monkeypatch):
    centroids = search.ivf_centroids(corpus, 4)
    whole = search.ivf_knn(corpus, queries, centroids, 10, 2).collect()
    monkeypatch.setattr(search, "SHARD", 30)
    assert sorted(map(tuple, search.ivf_knn(corpus, queries, centroids, 10, 2).collect())) == sorted(map(tuple, whole))


def test_ivf_recall_and_full_probe(corpus, queries):
    exact = search.knn(corpus, queries, 10)
    centroids = search.ivf_centroids(corpus, 16)
    assert search.recall(search.ivf_knn(corpus, queries, centroids, 10, 16), exact).first()["recall"] == 1
    probes = search.tuned_probes(corpus, queries, centroids)
    assert 1 <= probes < 16
    assert search.recall(search.ivf_knn(corpus, queries, centroids, 10, probes), exact).first()["recall"] >= 0.9


def test_quantized_search_ranks_more_exactly(corpus, queries):
    """Where coarse codes lose neighbours, what is ranked exactly doubles until a recall of 0.9 is reached."""
    exact, books, c = search.knn(corpus, queries, 10), search.pq_codebooks(corpus, 2, 4), search.ivf_centroids(corpus, 4)
    rough = search.ivf_knn(corpus, queries, c, 10, len(c), codebooks=books)
    assert search.recall(rough, exact).first()["recall"] < 0.9
    found = search.tuned_quantized_knn(corpus, queries, c, books, exact)
    assert search.recall(found, exact).first()["recall"] >= 0.9 and found.groupBy("query_id").count().agg({"count": "max"}).first()[0] == 10


def test_tuned_planes_and_probes_are_the_fewest(corpus, queries):
    """The numbers that the pairs tell are those at which the searches themselves reach the recall, and one less does not."""
    exact = search.knn(corpus, queries, 10)
    reached = lambda found: search.recall(found, exact).first()["recall"] >= 0.9
    normals, centroids = search.tuned_planes(corpus, queries), search.ivf_centroids(corpus, 16)
    assert len(normals) > 1
    assert reached(search.lsh_knn(corpus, queries, normals)) and not reached(search.lsh_knn(corpus, queries, normals[:-1]))
    n = search.tuned_probes(corpus, queries, centroids)
    assert not reached(search.ivf_knn(corpus, queries, centroids, 10, n - 1))
    few = search.tuned_planes(corpus, queries, most=8)  # fewer bits where the tables don't suffice
    assert len(few) <= 8 and few.shape[1] < normals.shape[1] and reached(search.lsh_knn(corpus, queries, few))


def test_a_task_holds_few_distances(corpus, queries, monkeypatch):
    """Blocks of a few cells change no result."""
    normals, centroids = search.planes(64, 12, 5), search.ivf_centroids(corpus, 8)
    runs = lambda: [sorted(map(tuple, f.collect())) for f in (search.knn(corpus, queries, 5), search.lsh_knn(corpus, queries, normals, 5), search.ivf_knn(corpus, queries, centroids, 5, 3))]
    whole = runs()
    monkeypatch.setattr(search, "CELLS", 700)
    assert runs() == whole


def test_lsh_recall_grows_with_tables(corpus, queries):
    exact = search.knn(corpus, queries, 10)
    few = search.recall(search.lsh_knn(corpus, queries, search.planes(64, 2, 10), 10), exact).first()["recall"]
    many = search.recall(search.lsh_knn(corpus, queries, search.planes(64, 60, 6), 10), exact).first()["recall"]
    assert few <= many and many >= 0.9


def test_quantization_round_trip(corpus):
    c = ops.calibration(corpus)
    back = ops.dequantized(ops.quantized(corpus, 8, c), 8, c)
    gap = F.array_max(F.zip_with(V.doubles("embedding"), "back", lambda x, y: F.abs(x - y)))
    low, high = (np.array(x) for x in c.first())
    assert back.agg(F.max(gap)).first()[0] <= (high - low).max() / 255 + 1e-6
    with pytest.raises(ValueError):
        ops.quantized(corpus, 5, c)


def test_temperature_sampling(spark):
    """First draws follow exp(-d / T), and reruns agree."""
    rows = [(q, v, d, v + 1) for q in range(4000) for v, d in enumerate((0.1, 0.5, 1.2))]
    results = spark.createDataFrame(rows, "query_id long, vec_id long, distance double, rank int")
    one = fusion.temperature_sample(results, 1, 1.0, multiplier=3)
    n = dict(one.groupBy("vec_id").count().collect())
    p = np.exp(-np.array([0.1, 0.5, 1.2]))
    p /= p.sum()
    assert np.allclose([n[i] / 4000 for i in range(3)], p, atol=0.03)
    assert one.exceptAll(fusion.temperature_sample(results, 1, 1.0, multiplier=3)).count() == 0
    assert fusion.temperature_sample(results, 2, 1.0).groupBy("query_id").count().where("count <> 2").count() == 0


def test_hybrid_weights_and_strategies(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 1)], "query_id long, vec_id long, distance double, rank int")
    with pytest.raises(ValueError):
        retrieval.hybrid(df, F.lit(0.0), 5, 0.9, 0.3)
    with pytest.raises(ValueError):
        fusion.expanded(df.withColumn("query", F.lit("x")), "bold")


def test_kmeans_separates_and_small_corpora_are_refused(spark):
    g = np.random.default_rng(42)
    rows = [(i * 50 + j, (g.standard_normal(8) + 20 * (i - 1)).tolist(), i) for i in range(3) for j in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, truth int")
    found, centres = analytics.kmeans(df, 3)
    assert len(centres) == 3 and found.groupBy("truth").agg(F.countDistinct("cluster").alias("n")).where("n <> 1").count() == 0
    with pytest.raises(ValueError):
        analytics.cluster_count(3)


def test_drift_of_a_shifted_copy(spark):
    g = np.random.default_rng(1)
    rows = [(i, (g.standard_normal(16) + (3 if i >= 100 else 0)).tolist(), "current" if i >= 100 else "baseline") for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side string")
    d = analytics.drift(df).first()
    assert d["drifted"] and d["severity"] == "high" and d["ks_statistic"] > 0.9
    with pytest.raises(ValueError):
        analytics.drift(df.where("vec_id < 10 or vec_id > 190"))


def test_age_counts_parts_of_a_second(spark):
    """Half a second less than a day is no day; a whole day is one."""
    df = spark.sql("SELECT timestamp'2024-01-31 00:00:00.5' AS ts UNION ALL SELECT timestamp'2024-01-31 00:00:00' UNION ALL SELECT timestamp'2024-02-01 00:00:00.5'")
    assert sorted(r[0] for r in df.select(retrieval.age_days("ts", "2024-02-01")).collect()) == [-1, 0, 1]


def test_signature(spark):
    got = spark.createDataFrame([("payload", "key")], "p string, s string").select(E.signature("p", "s")).first()[0]
    assert got == "sha256=" + hmac.new(b"key", b"payload", hashlib.sha256).hexdigest()
    odd = [("", ""), ("päyload", "sécret"), ("x" * 1000, "k" * 64), ("x", "k" * 65), ("6\\", "6\\")]
    for r in spark.createDataFrame(odd, "p string, s string").select("p", "s", E.signature("p", "s").alias("h")).collect():
        assert r["h"] == "sha256=" + hmac.new(r["s"].encode(), r["p"].encode(), hashlib.sha256).hexdigest()


def test_split_is_by_order_of_ids(spark):
    df = spark.createDataFrame([(i * i * 7 - 50,) for i in range(3000)], "vec_id long")
    ids = sorted(r[0] for r in df.collect())
    assert {r[0] for r in analytics.split(df).where("side = 'baseline'").collect()} == set(ids[:2100])


def test_streams_deduplicate_and_resume(spark, tmp_path):
    rows = [(i % 5, "click") for i in range(20)]
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = spark.createDataFrame(rows, "event_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(src)
    stream = E.deduplicated(E.event_stream(spark, src, df.schema))
    sink = lambda b, n: b.write.mode("append").parquet(out)
    E.run_once(stream, sink, cp)
    assert spark.read.parquet(out).count() == 5
    df.write.mode("append").parquet(src)
    E.run_once(E.deduplicated(E.event_stream(spark, src, df.schema)), sink, cp)
    assert spark.read.parquet(out).count() == 5


def test_catalog(spark, tmp_path):
    cat = C.Catalog(spark, str(tmp_path / "cat"))
    key = cat.create_corpus("news", 4)
    with pytest.raises(ValueError):
        cat.create_corpus("bad", 4, index_type="magic")
    batch = spark.createDataFrame(
        [(0, "a", "First", [("one", [1.0, 0.0, 0.0, 0.0]), ("two", [0.0, 2.0, 0.0, 0.0])]), (1, "b", None, [("three", [0.0, 0.0, 0.0, 0.0])]), (2, "c", None, [("four", [1.0, 1.0, 0.0, 0.0])])],
        "idx int, document_id string, title string, chunks array<struct<text: string, embedding: array<float>>>",
    ).selectExpr("*", "cast(null as string) author", "cast(null as string) document_type", "cast(null as string) source_url", "cast(null as array<string>) tags")
    n, bad = cat.add_documents(key, batch)
    assert n == 3 and [tuple(r) for r in bad.collect()] == [(1, "embedding")]
    assert cat.list_corpora().first()["num_documents"] == 2
    assert {r["title"] for r in cat.documents().collect()} == {"First", "Untitled"}
    assert cat.statistics().select("documents", "chunks").first() == (2, 3)
    export = cat.export(str(tmp_path / "out")).first()
    assert export["documents"] == 2 and export["chunks"] == 3
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert all("embedding" not in c for d in lines for c in d["chunks"])
    assert cat.set_index(key, "ivf") == ("brute_force", "ivf", 3)
    missing = cat.delete_documents(spark.createDataFrame([("a",), ("zzz",)], "document_id string"))
    assert [tuple(r) for r in missing.collect()] == [("zzz", "Document not found")]
    assert cat.chunks().count() == 1
    assert {r["key"] for r in C.replayed(cat.operations()).collect()} == {"c"}
    assert cat.compact(1) == 1
    assert cat.delete_corpus(key) and not cat.delete_corpus(key)
    assert cat.chunks().count() == 0


def test_catalog_embeds_texts(spark, tmp_path):
    cat = C.Catalog(spark, str(tmp_path / "cat"))
    key = cat.create_corpus("texts", 64)
    batch = spark.createDataFrame([(0, "a", "T", [("hello world", None), ("other words", None)])], "idx int, document_id string, title string, chunks array<struct<text: string, embedding: array<float>>>")
    batch = batch.selectExpr("*", "cast(null as string) author", "cast(null as string) document_type", "cast(null as string) source_url", "cast(null as array<string>) tags")
    n, bad = cat.add_documents(key, batch, hash_embedding)
    assert n == 2 and bad.count() == 0


def test_a_document_may_have_any_number_of_chunks(spark, tmp_path):
    cat = C.Catalog(spark, str(tmp_path / "cat"))
    key, none = cat.create_corpus("long", 64), "cast(null as string)"
    texts = F.transform(F.sequence(F.lit(1), F.lit(1_500)), lambda i: F.struct(F.concat(F.lit("word number "), i).alias("text"), F.lit(None).cast("array<float>").alias("embedding")))
    batch = spark.range(1).select(F.col("id").alias("idx"), F.lit("a").alias("document_id"), texts.alias("chunks")).selectExpr("*", f"{none} title", f"{none} author", f"{none} document_type", f"{none} source_url", "cast(null as array<string>) tags")
    n, bad = cat.add_documents(key, batch, hash_embedding)
    assert n == 1_500 and bad.count() == 0 and cat.chunks().count() == 1_500


def test_commits_can_be_read_again_and_lost_ones_are_not_seen(spark, tmp_path):
    cat = C.Catalog(spark, str(tmp_path / "cat"))
    assert cat.corpora().count() == 0 and cat.last_commit() == 0
    key = cat.create_corpus("a", 4)
    cat.create_corpus("b", 4)
    assert cat.corpora().count() == 2 and cat.corpora(as_of=1).count() == 1
    cat.corpora().withColumn("corpus_id", F.lit("lost")).write.parquet(f"{cat.path}/corpora/commit=3")  # a job that ended before its log line
    assert cat.corpora().count() == 2 and cat.last_commit() == 2
    cat.set_index(key, "hnsw")
    assert {r["name"]: r["index_type"] for r in cat.corpora().collect()} == {"a": "hnsw", "b": "brute_force"}
    assert cat.corpora(as_of=2).where("index_type = 'hnsw'").count() == 0
    cat.compact(1)
    assert cat.corpora().count() == 2 and cat.delete_corpus(key) and [r["name"] for r in cat.corpora().collect()] == ["b"]


def test_embedding_connector(spark):
    rows = spark.createDataFrame([(i, "x" * 600_000 if i == 5 else "" if i == 6 else f"word {i}") for i in range(250)], "doc_id long, text string").coalesce(1)

    def call(texts, kind):
        assert len(texts) <= 96 and kind == "search_query"
        if any(t == "word 249" for t in texts):
            raise embed.TransientError("busy")
        return [[3.0, 4.0, 12.0] if t else [0.0, 0.0, 5.0] for t in texts]

    got = {r["doc_id"]: r for r in embed.embedded(rows, call, 2, "search_query", wait=0.0).collect()}
    assert len(got) == 250 and got[5]["error"] == "text is too long" and got[6]["error"] == "zero norm"
    assert got[0]["error"] is None and np.allclose(got[0]["embedding"], [0.6, 0.8])
    assert all(got[i]["error"] == "the service failed: busy" for i in range(192, 250)) and got[191]["error"] is None
    with pytest.raises(ValueError):
        embed.embedded(rows, call, 2, "poetry")


def test_log_keeps_lines_that_it_cannot_read(spark, tmp_path):
    p = tmp_path / "log.json"
    p.write_text('{"operation": "a", "key": "1", "ts": "2024-01-01T00:00:00Z"}\n{broken\n{"operation": "b", "key": "2", "ts": "2025-01-01T00:00:00Z"}\n')
    kept = C.truncated(C.read_log(spark, str(p)).cache(), "2024-06-01")
    assert sorted(str(r["operation"]) for r in kept.collect()) == ["None", "b"]

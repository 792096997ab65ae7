"""T and X: events, subscriptions, jobs, webhooks, and tenancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.functions.embed import hash_embedding
from vectorloom.operators import retrieval, search, tenancy
from vectorloom.sources.shared import fresh_path
from vectorloom.streaming import events as E

from .registry import query, table
from .retrieval_queries import WORDS, hashed_sql
from .sql import results, results_sql

HOOKS = """hooks(webhook_id, tenant_id, status, events) AS (VALUES (1, 0, 'active', ['*']), (2, 1, 'active', ['click', 'view']), (3, 2, 'paused', ['*']), (4, 3, 'active', ['purchase']), (5, 1, 'active', ['error', '*']))"""
HOOK_ROWS = [(1, 0, "active", ["*"]), (2, 1, "active", ["click", "view"]), (3, 2, "paused", ["*"]), (4, 3, "active", ["purchase"]), (5, 1, "active", ["error", "*"])]
EV = "ev AS (SELECT event_id, event_type, CASE WHEN event_id % 5 <> 4 THEN user_id % 4 END AS tenant_id FROM events)"
MATCHED = f"{HOOKS}, {EV}, met AS (SELECT event_id, webhook_id FROM ev JOIN hooks h ON (ev.tenant_id IS NULL OR ev.tenant_id = h.tenant_id) AND h.status = 'active' AND (list_contains(h.events, '*') OR list_contains(h.events, ev.event_type)))"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def matched(spark, sf_dir):
    hooks = spark.createDataFrame(HOOK_ROWS, "webhook_id long, tenant_id long, status string, events array<string>")
    e = events(spark, sf_dir).select("event_id", "event_type", F.when(F.col("event_id") % 5 != 4, F.col("user_id") % 4).alias("tenant_id"))
    return E.matched_webhooks(e, hooks)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def t1_subscribe(spark, sf_dir):
    return E.subscribed(events(spark, sf_dir), ["click", "purchase"]).select("event_id", "event_type")


SUBS = "subs(subscriber, event_type) AS (VALUES ('all', NULL), ('clicks', 'click'), ('errors', 'error'), ('both', 'click'), ('both', 'view'))"
SUB_ROWS = [("all", None), ("clicks", "click"), ("errors", "error"), ("both", "click"), ("both", "view")]


@query(f"WITH {SUBS} SELECT subscriber, count(*) AS delivered, count(*) FILTER (event_id % 10 = 0) AS errors, count(*) FILTER (event_id % 10 = 1) AS pending FROM events e JOIN subs s ON s.event_type IS NULL OR s.event_type = e.event_type GROUP BY subscriber")
def t2_bus_statistics(spark, sf_dir):
    """What each subscriber was sent, what its handler failed on, and what it hasn't answered: of ten events one fails and one is open."""
    subs = spark.createDataFrame(SUB_ROWS, "subscriber string, event_type string")
    sent = E.delivered(events(spark, sf_dir), subs)
    answers = sent.where("event_id % 10 <> 1").select("event_id", "subscriber", (F.col("event_id") % 10 != 0).alias("ok"))
    return E.bus_statistics(sent, answers)


@query("SELECT 'document_added' AS event_type, doc_id AS key, source AS corpus FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'corpus_created', NULL, source FROM documents GROUP BY source")
def t3_change_events(spark, sf_dir):
    """Change events of creations and additions; deletions make none."""
    d = table(spark, sf_dir, "documents")
    log = d.select(F.when(F.col("doc_id") % 3 == 0, "delete_document").otherwise("add_document").alias("op"), F.col("doc_id").alias("key"), F.col("source").alias("corpus"))
    made = log.select("corpus").distinct().select(F.lit("create_corpus").alias("op"), F.lit(None).cast("long").alias("key"), "corpus")
    names = F.when(F.col("op") == "add_document", "document_added").when(F.col("op") == "create_corpus", "corpus_created")
    return log.unionByName(made).withColumn("event_type", names).where("event_type is not null").select("event_type", "key", "corpus")


@query("SELECT event_id, user_id % 10 AS corpus FROM events WHERE user_id % 10 = 3")
def t4_corpus_stream(spark, sf_dir):
    """A subscriber of one corpus: a stream over the events' files, filtered, each event once, in micro-batches."""
    folder = fresh_path(spark, "corpus-stream")
    stream = spark.readStream.schema(events(spark, sf_dir).schema).option("pathGlobFilter", "*.parquet").parquet(_files(sf_dir, "events"))
    mine = E.deduplicated(stream.withColumn("corpus", F.col("user_id") % 10).where("corpus = 3"), "3650 days")
    E.run_once(mine, lambda df, n: df.select("event_id", "corpus").write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.schema("event_id long, corpus long").parquet(f"{folder}/out")


def _files(sf_dir: str, name: str) -> str:
    """A table's path for a stream, which reads folders, or files by a pattern."""
    return f"{sf_dir}/{name}[.]parquet"


@query("SELECT c.c_custkey AS connection_id, count(*) AS messages FROM customer c JOIN events e ON e.user_id % 10 = c.c_custkey % 10 AND e.event_type = 'error' GROUP BY 1")
def t5_broadcast(spark, sf_dir):
    """Connections get the messages of the corpora that they watch."""
    conn = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("connection_id"), (F.col("c_custkey") % 10).alias("corpus"))
    sent = events(spark, sf_dir).where("event_type = 'error'").groupBy((F.col("user_id") % 10).alias("corpus")).agg(F.count("*").alias("messages"))
    return conn.join(sent, "corpus").select("connection_id", "messages")


@query(f"WITH {results_sql(3)} SELECT query_id, count(*) AS hits, round(min(distance), 6) AS nearest FROM results GROUP BY query_id")
def t6_search_action(spark, sf_dir):
    return results(spark, sf_dir, 3).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.min("distance"), 6).alias("nearest"))


JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_orderkey % 6 AS fails, o_orderpriority AS job_type, o_orderdate AS created_at FROM orders)"


def jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 6).alias("fails"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH {JOBS} SELECT job_id, least(fails + 1, 4) AS attempts, CASE WHEN fails <= 3 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN fails <= 3 THEN 100.0 ELSE 0.0 END AS progress FROM jobs")
def t7_job_execution(spark, sf_dir):
    return E.executed(jobs(spark, sf_dir)).select("job_id", "attempts", "status", "progress")


@query(f"WITH {JOBS} SELECT job_type, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY created_at DESC, job_id DESC) AS n FROM jobs) WHERE n <= 10")
def t7_list_jobs(spark, sf_dir):
    return E.newest(jobs(spark, sf_dir).withColumn("id", F.col("job_id")), 10, "job_type").select("job_type", "job_id")


@query("SELECT CASE WHEN fails <= 3 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n FROM (SELECT o_orderkey % 6 AS fails FROM orders) GROUP BY 1")
def t9_queue_statistics(spark, sf_dir):
    return E.executed(jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {MATCHED} SELECT event_id, webhook_id FROM met")
def t10_webhook_match(spark, sf_dir):
    return matched(spark, sf_dir)


@query(f"WITH {MATCHED}, a AS (SELECT *, (event_id + webhook_id) % 5 AS fails, unnest(range(1, least((event_id + webhook_id) % 5 + 1, 3) + 1)) AS attempt FROM met), s AS (SELECT *, CASE WHEN attempt > fails THEN 'success' WHEN attempt < 3 THEN 'retrying' ELSE 'failed' END AS status FROM a) SELECT webhook_id, count(*) AS total, sum((status = 'success')::INT)::BIGINT AS successes, round(100 * sum((status = 'success')::INT) / count(*), 2) AS success_rate FROM s GROUP BY webhook_id")
def t11_webhook_delivery(spark, sf_dir):
    return E.success_rate(E.attempts(matched(spark, sf_dir), (F.col("event_id") + F.col("webhook_id")) % 5))


def _xor(c: str, byte: int) -> str:
    return f"list_transform(range(64), lambda i: printf('%02x', xor(coalesce(('0x' || nullif(substr(hex(encode({c})), 2 * i + 1, 2), ''))::INT, 0), {byte})))"


SIGNED = f"""p AS (SELECT event_id, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}}' AS payload, 'secret-' || user_id % 4 AS secret FROM events WHERE event_type = 'purchase'),
k AS (SELECT *, unhex(array_to_string({_xor('secret', 54)}, '')) AS inner_key, unhex(array_to_string({_xor('secret', 92)}, '')) AS outer_key FROM p)"""


@query(f"WITH {SIGNED} SELECT event_id, 'sha256=' || sha256(outer_key || unhex(sha256(inner_key || encode(payload)))) AS signature FROM k")
def t11_webhook_signature(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("event_id", E.signature(F.to_json(F.struct("event_id", "event_type", "user_id")), F.concat(F.lit("secret-"), F.col("user_id") % 4)).alias("signature"))


ASKED = r"""c AS (SELECT conv_id AS query_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS s FROM conversations WHERE turn = 0 AND conv_id % 100 = 0),
asked AS (SELECT query_id, replace(replace(replace(replace(replace(replace(regexp_replace(s, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s?.!]', '', 'g'), ' ML ', ' machine learning '), ' AI ', ' artificial intelligence '), ' NLP ', ' natural language processing '), ' DL ', ' deep learning '), ' CNN ', ' convolutional neural network '), ' RNN ', ' recurrent neural network ') AS query FROM c)"""


@query(f"""WITH {ASKED}, src AS (SELECT doc_id AS sid, text FROM documents UNION ALL SELECT -1 - query_id, query FROM asked), {hashed_sql('src', 'sid')},
e AS (SELECT id, pos, v / norm AS v FROM p JOIN n USING (id) WHERE norm > 0),
dots AS (SELECT -1 - q.id AS query_id, c.id AS vec_id, sum(q.v * c.v) AS s FROM e q JOIN e c USING (pos) WHERE q.id < 0 AND c.id >= 0 GROUP BY ALL),
pairs AS (SELECT a.query_id, a.query, d.doc_id AS vec_id, d.text, d.doc_id % 10 AS chunk_index, round(1 - coalesce(s, 0), 6) + 0.0 AS distance FROM asked a CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = a.query_id AND dots.vec_id = d.doc_id),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS old_rank FROM pairs QUALIFY old_rank <= 10),
m AS (SELECT *, {WORDS.format('query')} AS qw, {WORDS.format('text')} AS tw FROM found),
scored AS (SELECT *, round(0.4 * (1 - distance / 2) + 0.4 * (len(list_intersect(qw, tw)) / greatest(len(qw), 1)) + 0.2 / (chunk_index + 1), 6) AS score FROM m),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM scored QUALIFY rank <= 5),
g AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS a, count(*) AS n_sources, round(max(1 - distance), 6) AS top_relevance FROM best GROUP BY query_id)
SELECT query_id, CASE WHEN length(a) > 500 THEN substr(a, 1, 500) || '...' ELSE a END AS context, n_sources, top_relevance FROM g""")
def t12_rag_workflow(spark, sf_dir):
    """Questions, from the first turns of conversations, preprocessed and embedded; the nearest documents reranked by words and
    put together."""
    c = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 100 = 0")
    asked = c.select(F.col("conv_id").alias("query_id"), retrieval.preprocessed(F.col("text")).alias("query"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", hash_embedding(F.col("text")).alias("embedding"), (F.col("doc_id") % 10).alias("chunk_index"))
    found = search.knn(d, asked.select("query_id", hash_embedding(F.col("query")).alias("embedding")), 10)
    rows = found.join(d.drop("embedding"), "vec_id").join(asked, "query_id")
    return retrieval.context(retrieval.keyword_rerank(rows, F.col("query"), 5))


@query("SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS chunks FROM conversations GROUP BY conv_id")
def t13_batch_embed_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("chunks"))


@query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def t14_rate_limit(spark, sf_dir):
    return E.over_limit(events(spark, sf_dir), 1, "1 hour")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def t15_page(spark, sf_dir):
    return E.page(events(spark, sf_dir).select("event_id", "ts"), 3, 50, F.desc("ts"), "event_id")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t_windowed_stream(spark, sf_dir):
    """A stream over the events' file, aggregated by day in micro-batches, and read back."""
    folder = fresh_path(spark, "windowed")
    schema = events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_files(sf_dir, "events"))
    out = f"{folder}/out"
    E.run_once(E.windowed(stream, "1 day"), lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), f"{folder}/checkpoint", "update")
    found = spark.read.parquet(out)
    last = found.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    return last.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


TENANTS = "tenants AS (SELECT c_custkey AS tenant_id, sha256('key-' || c_custkey) AS key_hash, c_custkey % 5 <> 0 AS is_active, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 100)::INT) END AS expires_at FROM customer)"


@query(f"WITH {TENANTS}, req AS (SELECT event_id AS request_id, 'key-' || (user_id * 7 % 2000) AS api_key FROM events) SELECT request_id, CASE WHEN coalesce(is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01'), false) THEN tenant_id END AS tenant_id, coalesce(is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01'), false) AS valid FROM req LEFT JOIN tenants ON key_hash = sha256(api_key)")
def x1_validate_api_key(spark, sf_dir):
    requests = events(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.concat(F.lit("key-"), F.col("user_id") * 7 % 2000).alias("api_key"))
    return tenancy.validated_keys(requests, _tenants(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))


def _tenants(spark, sf_dir):
    n = F.col("c_custkey")
    day = F.timestamp_seconds(F.lit(1704067200) + n % 100 * 86400)
    return table(spark, sf_dir, "customer").select(n.alias("tenant_id"), tenancy.key_hash(F.concat(F.lit("key-"), n)).alias("key_hash"), (n % 5 != 0).alias("is_active"), F.when(n % 3 == 0, day).alias("expires_at"))


@query(f"WITH {TENANTS}, req AS (SELECT 'key-' || (user_id * 7 % 2000) AS api_key, ts FROM events) SELECT tenant_id, count(*) AS request_count, max(ts) AS last_used_at FROM req JOIN tenants ON key_hash = sha256(api_key) WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01') GROUP BY tenant_id")
def x1_key_usage(spark, sf_dir):
    """Requests and last use of each valid key."""
    requests = events(spark, sf_dir).select("ts", F.concat(F.lit("key-"), F.col("user_id") * 7 % 2000).alias("api_key"))
    return tenancy.key_usage(requests, _tenants(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))


@query(f"WITH {TENANTS} SELECT tenant_id, CASE WHEN tenant_id % 10 = 1 THEN sha256('new-' || tenant_id) ELSE key_hash END AS key_hash, is_active AND tenant_id % 10 <> 2 AS is_active FROM tenants")
def x1_rotate_and_deactivate(spark, sf_dir):
    """Of ten tenants one gets a new key and one is deactivated."""
    t = _tenants(spark, sf_dir)
    new = t.where("tenant_id % 10 = 1").select("tenant_id", F.concat(F.lit("new-"), "tenant_id").alias("new_key"))
    return tenancy.deactivated(tenancy.rotated(t, new), t.where("tenant_id % 10 = 2").select("tenant_id")).select("tenant_id", "key_hash", "is_active")


@query(f"WITH {TENANTS} SELECT tenant_id, is_active, expires_at FROM tenants")
def s15_tenant_store(spark, sf_dir):
    """Tenants written as JSON and read again."""
    path = fresh_path(spark, "tenants")
    tenancy.save_tenants(_tenants(spark, sf_dir), path)
    return tenancy.load_tenants(spark, path).select("tenant_id", "is_active", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("SELECT event_id, severity FROM (SELECT event_id, ['debug', 'info', 'warning', 'error', 'critical'][event_id % 5 + 1] AS severity FROM events) WHERE severity IN ('error', 'critical')")
def s16_audit_log(spark, sf_dir):
    """Audit events at or above a severity, appended to a JSON log and read again."""
    severity = F.element_at(F.array(*map(F.lit, tenancy.SEVERITIES)), (F.col("event_id") % 5 + 1).cast("int"))
    path = fresh_path(spark, "audit")
    tenancy.append_audit(events(spark, sf_dir).select("event_id", severity.alias("severity")), path, "error")
    return spark.read.schema("event_id long, severity string").json(path)


ROLES = "roles(role, scope) AS (VALUES " + ", ".join(f"('{r}', '{s}')" for r, ss in tenancy.ROLE_SCOPES.items() for s in ss) + ")"
USERS = "users AS (SELECT c_custkey AS user_id, unnest(CASE c_custkey % 5 WHEN 0 THEN ['viewer'] WHEN 1 THEN ['viewer', 'user'] WHEN 2 THEN ['developer'] WHEN 3 THEN ['admin', 'viewer'] ELSE ['superuser'] END) AS role FROM customer)"


@query(f"WITH {ROLES}, {USERS}, s AS (SELECT user_id, list(DISTINCT scope) AS scopes FROM users LEFT JOIN roles USING (role) GROUP BY user_id), g AS (SELECT user_id, list_contains(scopes, 'admin:all') AS root, list_contains(scopes, 'libraries:admin') AS lib, list_contains(scopes, 'index:admin') AS idx, scopes FROM s) SELECT user_id, len(scopes) AS n_scopes, root OR lib OR list_contains(scopes, 'libraries:delete') AS libraries_delete, root OR idx OR list_contains(scopes, 'index:write') AS index_write, root OR list_contains(scopes, 'logs:read') AS logs_read FROM g")
def x2_scopes(spark, sf_dir):
    n = F.col("c_custkey") % 5
    lists = F.when(n == 0, F.array(F.lit("viewer"))).when(n == 1, F.array(F.lit("viewer"), F.lit("user"))).when(n == 2, F.array(F.lit("developer"))).when(n == 3, F.array(F.lit("admin"), F.lit("viewer"))).otherwise(F.array(F.lit("superuser")))
    s = tenancy.scopes_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(lists).alias("role")))
    grant = lambda scope: tenancy.has_scope(F.col("scopes"), F.lit(scope)).alias(scope.replace(":", "_"))
    return s.select("user_id", F.size("scopes").alias("n_scopes"), grant("libraries:delete"), grant("index:write"), grant("logs:read"))


@query("SELECT severity, count(*) AS n FROM (SELECT ['debug', 'info', 'warning', 'error', 'critical'][event_id % 5 + 1] AS severity FROM events) WHERE severity IN ('warning', 'error', 'critical') GROUP BY severity")
def x3_audit_floor(spark, sf_dir):
    severity = F.element_at(F.array(*map(F.lit, tenancy.SEVERITIES)), (F.col("event_id") % 5 + 1).cast("int"))
    return tenancy.audited(events(spark, sf_dir).withColumn("severity", severity), "warning").groupBy("severity").agg(F.count("*").alias("n"))

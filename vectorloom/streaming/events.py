"""Events, subscriptions, jobs, webhooks and rate limits over event tables and streams.

Functions take batch or streaming DataFrames alike where Structured Streaming allows it; `run_once` drives a stream over
what is there now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Subscribers to all events that `delivered` takes.
MOST_SUBSCRIBERS = 10_000


def subscribed(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The events of a subscriber; all without types."""
    return events if types is None else events.where(F.col("event_type").isin(types))


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand each micro-batch of what is there now to `sink`; the checkpoint makes reruns go on where this one ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, with state that a watermark bounds."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def windowed(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; on streams late events beyond the delay are left out."""
    if events.isStreaming:  # watermarks need times with a zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def over_limit(events: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """(user_id, window_start, n): users with more events in a window than the limit."""
    g = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """An event for each subscriber of its type; a null type subscribes to all. Subscribers to all are added to each event as an
    array, which is as long as they are many."""
    typed = events.join(subscriptions.where("event_type is not null"), "event_type").select("event_id", "subscriber")
    every = [r[0] for r in subscriptions.where("event_type is null").select("subscriber").distinct().limit(MOST_SUBSCRIBERS + 1).collect()]
    if len(every) > MOST_SUBSCRIBERS:
        raise ValueError(f"more than {MOST_SUBSCRIBERS} subscribers to all events")
    return typed.unionByName(events.select("event_id", F.explode(F.array(*map(F.lit, every)).cast("array<string>")).alias("subscriber")))


def bus_statistics(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """(subscriber, delivered, errors, pending) from what was sent (event_id, subscriber) and answered (event_id, subscriber, ok)."""
    met = sent.join(answers, ["event_id", "subscriber"], "left")
    return met.groupBy("subscriber").agg(F.count("*").alias("delivered"), F.count(F.when(~F.col("ok"), 1)).alias("errors"), F.count(F.when(F.col("ok").isNull(), 1)).alias("pending"))


# ---- webhooks -----------------------------------------------------------------------------------------------------


def matched_webhooks(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """(event_id, webhook_id): active hooks of the event's tenant (any, if it has none) that want its type or all.

    Events of a tenant meet its hooks by tenant and type, so hooks for all types are no hot key; only events without a
    tenant meet the hooks of all tenants, by type. A hook that wants a type twice over is one.
    """
    hooks = webhooks.where("status = 'active'").select("webhook_id", F.col("tenant_id").alias("hook_tenant"), F.explode(F.array_distinct("events")).alias("wants"))
    wanted = events.select("event_id", "tenant_id", F.explode(F.array(F.col("event_type"), F.lit("*"))).alias("wants"))
    own = wanted.where("tenant_id is not null").join(hooks.withColumnRenamed("hook_tenant", "tenant_id"), ["tenant_id", "wants"])
    free = wanted.where("tenant_id is null").join(hooks, "wants")
    return own.select("event_id", "webhook_id").unionByName(free.select("event_id", "webhook_id")).distinct()


def _padded(key: Column, byte: int) -> Column:
    """A key of at most 64 bytes, padded with zeros, each byte xor `byte`, as binary."""
    code = lambda i: F.conv(F.substring(F.hex(key), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.when(i < F.octet_length(key), code(i)).otherwise(0).bitwiseXOR(F.lit(byte)).cast("long")), 2, "0"))
    return F.unhex(F.array_join(bytes_, ""))


def signature(payload: Column | str, secret: Column | str) -> Column:
    """sha256=hex of HMAC-SHA256, from two digests."""
    payload, secret = (F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8") for c in (payload, secret))
    key = F.when(F.octet_length(secret) > 64, F.unhex(F.sha2(secret, 256))).otherwise(secret)
    inner = F.unhex(F.sha2(F.concat(_padded(key, 0x36), payload), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(_padded(key, 0x5C), inner), 256))


def attempts(deliveries: DataFrame, fails: Column, max_retries: int = 3, delay: int = 60) -> DataFrame:
    """(…, attempt, wait, status): a delivery's attempts until one succeeds; `fails` is how many would fail first, and each waits attempt * delay seconds."""
    n = F.least(fails + 1, F.lit(max_retries))
    out = deliveries.withColumn("fails", fails).withColumn("attempt", F.explode(F.sequence(F.lit(1), n)))
    status = F.when(F.col("attempt") > F.col("fails"), "success").when(F.col("attempt") < max_retries, "retrying").otherwise("failed")
    return out.withColumn("status", status).withColumn("wait", F.when(F.col("status") == "retrying", F.col("attempt") * delay).otherwise(0)).drop("fails")


def success_rate(attempted: DataFrame, key: str = "webhook_id") -> DataFrame:
    ok = F.sum((F.col("status") == "success").cast("int"))
    return attempted.groupBy(key).agg(F.count("*").alias("total"), ok.alias("successes"), F.round(100 * ok / F.count("*"), 2).alias("success_rate"))


def page(df: DataFrame, number: int, size: int = 50, *order: Column | str) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page or size out of range")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


# ---- jobs ---------------------------------------------------------------------------------------------------------

TERMINAL = ("completed", "failed", "cancelled")


def executed(jobs: DataFrame, max_retries: int = 3) -> DataFrame:
    """Run (job_id, fails) to the end: `attempts` until one succeeds or 1 + max_retries have failed, and the status."""
    n = F.least(F.col("fails") + 1, F.lit(max_retries + 1))
    return jobs.withColumn("attempts", n).withColumn("status", F.when(F.col("fails") <= max_retries, "completed").otherwise("failed")).withColumn("progress", F.when(F.col("status") == "completed", 100.0).otherwise(0.0))


def cancelled(jobs: DataFrame, ids: list[int]) -> DataFrame:
    """Cancel those of the jobs that haven't ended."""
    return jobs.withColumn("status", F.when(F.col("job_id").isin(ids) & ~F.col("status").isin(*TERMINAL), "cancelled").otherwise(F.col("status")))


def newest(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The newest rows by (created_at, id), for each key if there are any."""
    order = [F.desc("created_at"), F.desc("id")]
    if not keys:
        return df.orderBy(*order).limit(limit)
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= limit).drop("n")

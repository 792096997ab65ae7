"""Tenants, API keys, roles and audit events as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The scopes of each role.
ROLE_SCOPES = {
    "viewer": ["libraries:read", "documents:read", "search:read", "index:read", "tenant:read", "metrics:read"],
    "user": ["libraries:read", "libraries:write", "documents:read", "documents:write", "search:read", "search:advanced", "index:read", "tenant:read"],
    "developer": ["libraries:read", "libraries:write", "documents:read", "documents:write", "documents:delete", "search:read", "search:advanced", "index:read", "index:write", "index:admin", "tenant:read", "metrics:read", "logs:read"],
    "admin": ["libraries:read", "libraries:write", "libraries:delete", "libraries:admin", "documents:read", "documents:write", "documents:delete", "search:read", "search:advanced", "index:read", "index:write", "index:admin", "tenant:read", "tenant:admin", "api_keys:manage", "metrics:read", "logs:read"],
    "superuser": ["admin:all"],
}
SEVERITIES = ("debug", "info", "warning", "error", "critical")


def role_scopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, s) for r, scopes in ROLE_SCOPES.items() for s in scopes], "role string, scope string")


def scopes_of(users: DataFrame) -> DataFrame:
    """(user_id, scopes) from (user_id, role), scopes of all roles, sorted; unknown roles have none."""
    joined = users.join(F.broadcast(role_scopes(users.sparkSession)), "role", "left")
    return joined.groupBy("user_id").agg(F.sort_array(F.collect_set("scope")).alias("scopes"))


def has_scope(scopes: Column, required: Column) -> Column:
    """admin:all grants everything; libraries:admin and index:admin grant all of theirs."""
    out = F.array_contains(scopes, "admin:all") | F.array_contains(scopes, required)
    for area in ("libraries", "index"):
        out = out | (required.startswith(f"{area}:") & F.array_contains(scopes, f"{area}:admin"))
    return out


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def validated_keys(requests: DataFrame, tenants: DataFrame, as_of: Column) -> DataFrame:
    """(request_id, tenant_id, valid): keys are looked up by hash; the tenant must be active and not expired."""
    met = requests.withColumn("key_hash", key_hash(F.col("api_key"))).join(tenants, "key_hash", "left")
    valid = F.coalesce(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)), F.lit(False))
    return met.select("request_id", F.when(valid, F.col("tenant_id")).alias("tenant_id"), valid.alias("valid"))


def key_usage(requests: DataFrame, tenants: DataFrame, as_of: Column) -> DataFrame:
    """(tenant_id, request_count, last_used_at) of the requests (api_key, ts) whose keys are valid."""
    met = requests.withColumn("key_hash", key_hash(F.col("api_key"))).join(tenants, "key_hash")
    valid = met.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    return valid.groupBy("tenant_id").agg(F.count("*").alias("request_count"), F.max("ts").alias("last_used_at"))


def rotated(tenants: DataFrame, keys: DataFrame) -> DataFrame:
    """The tenants of `keys` (tenant_id, new_key) get those; old keys no longer work."""
    return tenants.join(keys, "tenant_id", "left").withColumn("key_hash", F.coalesce(key_hash(F.col("new_key")), F.col("key_hash"))).drop("new_key")


def deactivated(tenants: DataFrame, ids: DataFrame) -> DataFrame:
    """The tenants of `ids` (tenant_id) are no longer active."""
    gone = ids.select("tenant_id", F.lit(True).alias("gone"))
    return tenants.join(gone, "tenant_id", "left").withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).drop("gone")


TENANTS = "tenant_id long, key_hash string, is_active boolean, expires_at timestamp"


def save_tenants(tenants: DataFrame, path: str) -> None:
    tenants.write.mode("overwrite").json(path)


def load_tenants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TENANTS).json(path)


def append_audit(events: DataFrame, path: str, floor: str = "info") -> None:
    """Append audit events at or above a severity as JSON lines."""
    audited(events, floor).write.mode("append").json(path)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def audited(events: DataFrame, floor: str = "info") -> DataFrame:
    """Audit events at or above a severity."""
    return events.where(severity_rank(F.col("severity")) >= SEVERITIES.index(floor) + 1)

"""The silhouette over more vectors than the sample has, against its SQL and against numpy."""

import duckdb
import numpy as np
import pytest

from vectorloom.operators import analytics
from vectorloom.plans import registry


def test_all_vectors_count(spark):
    sf = "/root/testdata/sf0.1"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(registry.oracle_sql()["a14_silhouette"]).fetchall()[0][0]
    assert registry.queries()["a14_silhouette"](spark, sf).first()[0] == pytest.approx(want, abs=2e-6)


def test_blocks_merge(spark, monkeypatch):
    monkeypatch.setattr(analytics, "SILHOUETTE_BLOCK", 150)
    g = np.random.default_rng(3)
    label = g.integers(0, 3, 1200)
    x = g.normal(size=(1200, 5)) + label[:, None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = label[:, None] == label[None]
    a, b = np.where(same, d, 0).sum(1) / same.sum(1), np.where(same, np.inf, d).min(1)
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, cluster int, embedding array<double>")
    assert analytics.silhouette(df).first()[0] == pytest.approx(float(np.mean((b - a) / np.maximum(a, b))), abs=1e-9)
    assert analytics.silhouette(df.where("cluster = 0")).first()[0] == 0
    assert analytics.silhouette(df.where("false")).first()[0] == 0

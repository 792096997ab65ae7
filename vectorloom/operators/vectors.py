"""Validation, storage and quantization of vectors (vec_id, embedding)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V


def validated(df: DataFrame, dimension: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, their vectors normalised; and the others with a `problem`."""
    checked = df.withColumn("problem", V.problem(column, dimension))
    return checked.where("problem is null").withColumn(column, V.normalised(column)).drop("problem"), checked.where("problem is not null")


def consistent_documents(chunks: DataFrame) -> DataFrame:
    """(document_id, dims, consistent): whether all of a document's vectors have one length."""
    n = F.size("embedding")
    return chunks.groupBy("document_id").agg(F.min(n).alias("dims"), (F.min(n) == F.max(n)).alias("consistent"))


def deduplicated(df: DataFrame) -> DataFrame:
    """(vec_id, embedding, refs): vectors that agree to six places are stored once, under their least id."""
    key = F.transform(V.doubles("embedding"), lambda x: F.round(x, 6) + F.lit(0.0))
    return df.groupBy(key.alias("key")).agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"), F.count("*").alias("refs")).drop("key")


def dimension_rows(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row a value: pos, x."""
    return df.select(F.posexplode(column).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def calibrated(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(pos, low, high) of each dimension; constant dimensions get a tiny range."""
    return dimension_rows(df, column).groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).withColumn("high", F.when(F.col("high") - F.col("low") < 1e-8, F.col("low") + 1e-6).otherwise(F.col("high")))


def calibration(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: arrays low and high, as long as a vector."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "low", "high")))
    return calibrated(df, column).agg(pairs.alias("p")).select(F.col("p.low").alias("low"), F.col("p.high").alias("high"))


def literals(params: DataFrame) -> tuple:
    """(low, high) as literal arrays; they are as long as one vector."""
    row = params.first()
    return tuple(F.array(*[F.lit(float(x)) for x in v]) for v in (row["low"], row["high"]))


def quantized(df: DataFrame, bits: int = 8, params: DataFrame | None = None) -> DataFrame:
    """Add `q`, the vector in levels of each dimension's range."""
    low, high = literals(calibration(df) if params is None else params)
    return df.withColumn("q", V.quantize("embedding", low, high, bits))


def dequantized(df: DataFrame, bits: int, params: DataFrame) -> DataFrame:
    """Add `back`, the vector that the levels stand for."""
    low, high = literals(params)
    return df.withColumn("back", V.dequantize("q", low, high, bits))

"""Embeddings: a connector to a service that takes batches of texts, and a deterministic stand-in for one.

The stand-in is signed hashing of words, from md5, which every engine has.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A service's limits and what texts can be embedded for, and how often and how long a call is tried again.
BATCH, MOST_BYTES, ATTEMPTS, WAIT, LONGEST_WAIT = 96, 512 * 1024, 3, 2.0, 10.0
INPUT_TYPES = ("search_document", "search_query", "classification", "clustering")


class TransientError(Exception):
    """The service is busy or broken for now; trying again may help."""


def _called(call, texts: list[str], input_type: str, wait: float) -> list:
    for attempt in range(ATTEMPTS):
        try:
            return call(texts, input_type)
        except TransientError:
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(min(LONGEST_WAIT, wait * 2**attempt))
    raise AssertionError


def embedded(rows: DataFrame, call: Callable[[list[str], str], list], dimension: int, input_type: str = "search_document", text_col: str = "text", wait: float = WAIT) -> DataFrame:
    """`rows` with `embedding` and `error`: texts go to `call(texts, input_type)` in batches of at most BATCH, vectors are cut to
    `dimension` places and normalised. A text that is too long is refused by itself; a batch that fails after ATTEMPTS,
    or a vector that can't be used, gives its rows an error. One row of a batch is at most as long as its text."""
    if input_type not in INPUT_TYPES:
        raise ValueError(f"unknown input type: {input_type}")

    def of(texts: list[str]) -> tuple[list, list]:
        vectors, errors = [None] * len(texts), [None] * len(texts)
        fits = [i for i, t in enumerate(texts) if len(t.encode()) <= MOST_BYTES]
        for i in set(range(len(texts))) - set(fits):
            errors[i] = "text is too long"
        try:
            found = _called(call, [texts[i] for i in fits], input_type, wait) if fits else []
        except TransientError as e:
            for i in fits:
                errors[i] = f"the service failed: {e}"
            return vectors, errors
        for i, v in zip(fits, found, strict=True):
            v = np.asarray(v, np.float64)[:dimension]
            n = np.sqrt(v @ v)
            if len(v) < dimension or not np.isfinite(n) or n == 0:
                errors[i] = "zero norm" if len(v) == dimension and n == 0 else "not finite" if len(v) == dimension else "dimension"
            else:
                vectors[i] = (v / n).astype(np.float32)
        return vectors, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH].copy()
                vectors, errors = of([t or "" for t in part[text_col]])
                part["embedding"], part["error"] = pd.Series(vectors, part.index, dtype=object), pd.Series(errors, part.index, dtype=object)
                yield part

    kept = rows.drop("embedding", "error")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["embedding array<float>", "error string"])
    return kept.mapInPandas(run, schema)


def _place(word: str, dimension: int) -> tuple[int, float]:
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % dimension, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0


def hashed(text: str, dimension: int = 64, known: dict | None = None) -> np.ndarray:
    """A word adds 1 or -1 to one place, both from its md5; then the length is 1, or 0 for texts without words."""
    v, known = np.zeros(dimension), {} if known is None else known
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        if w not in known:
            known[w] = _place(w, dimension)
        v[known[w][0]] += known[w][1]
    n = np.sqrt(v @ v)
    return v / n if n else v


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """The stand-in's vectors of a column of texts."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        return pd.Series([hashed(t, dimension, known) for t in texts])

    return embed(text)

"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A document's features are its words and word pairs, the same of the words' shapes (capitals, digits, punctuation), and
whether a word repeats the one before; each kind of feature is a distribution that sums to one. A score is the sparse dot
product of those with the weights, through the logistic function.

Training reads a bounded sample of labelled rows (`SAMPLE`, chosen by a hash of the id) and streams it: shards start
from the mean state of all shards after the last pass and update it document by document; a state has a fixed size.
Everything else reads all rows.

Defined results: a null text is empty; a text without words has the score of the bias alone; without usable labels all
scores are 0.5; labels that disagree on a document count as the least; a null doc_id is scored but not learnt from; each
of repeated rows gets the same score; documents that tie at 0.5 count as good; very long texts are read whole; an empty
table gives an empty result; `keep_good` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, materialize, some, table, utf8

BITS = 18
DIM = 1 << BITS
#: About the most labelled rows that training reads.
SAMPLE = 20_000
SHARDS, PASSES = 4, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3
#: The registered query learns from rows whose crc32 of the id leaves another remainder by FOLDS than HELD.
FOLDS, HELD = 3, 1
U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> (hash of its letters, hash of its shape), both 64 bits; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        core = text.strip("".join({c for c in text if not c.isalnum()}))
        letters = "A" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "a" if core.isalpha() else "0" if core else "-"
        at = text.find(core) if core else 0
        shape = f"{text[:at][:8]}{letters}{text[at + len(core) :][:8]}" if core else text[:8]
        if len(self) > 60_000:
            self.clear()
        self[word] = out = (_hash(core.lower().encode()), _hash(b"shape:" + shape.encode()))
        return out


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def features(text: bytes, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values), indices distinct; index 0 is the bias."""
    pairs = [words[w] for w in text.split()]
    if not pairs:
        return np.zeros(1, np.int64), np.ones(1)
    h = np.array(pairs, np.uint64)
    kinds = [h[:, 0], h[:, 1]]
    if len(pairs) > 1:
        two = h[:-1] * MULTIPLIER + h[1:]
        same = (h[:-1, 0] == h[1:, 0]).astype(np.uint64) + U(77)
        kinds += [two[:, 0] ^ U(3), two[:, 1] ^ U(5), same * U(0xC2B2AE3D27D4EB4F)]
    at = np.concatenate([((k * MULTIPLIER) >> U(64 - BITS)).astype(np.int64) for k in kinds])
    worth = np.concatenate([np.full(len(k), 1.0 / len(k)) for k in kinds])
    at[at == 0] = 1
    index, place = np.unique(at, return_inverse=True)
    return np.concatenate(([0], index)), np.concatenate(([1.0], np.bincount(place, worth)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The FTRL-proximal weights of a state."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, index: np.ndarray, value: np.ndarray, label: int) -> None:
    """One FTRL-proximal update, in place."""
    zi, ni = z[index], n[index]
    w = weights(zi, ni)
    g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
    sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
    z[index], n[index] = zi + g - sigma * w, ni + g * g


def training_sample(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> DataFrame:
    """(shard, order, text, label) for at most about `sample` labelled rows that `use` allows."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(use).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    known = known.withColumn("order", order).where(F.pmod(F.shiftrightunsigned("order", 20), F.lit(1 << 20)) < share * (1 << 20))
    known = known.withColumn("shard", F.pmod("order", F.lit(SHARDS)))
    # the sample is bounded, and so is the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("shard", "order", "text", "label")


def _array(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer())


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the shards' states, of which there are SHARDS."""
    rows = sorted(((b["shard"][i].as_py(), b["z"][i], b["n"][i]) for b in batches for i in range(b.num_rows)), key=lambda r: r[0])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([np.mean([_array(r[k]) for r in rows], axis=0).tobytes()], pa.binary()) for k in (1, 2)], ["z", "n"])


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in some(batches):
        yield pa.RecordBatch.from_arrays([pa.array([weights(_array(b["z"][0]), _array(b["n"][0])).tobytes()], pa.binary())], ["w"])


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by shard, its state first if there is one: update the state document by document."""
    words, now, state, learnt = _Words(), None, None, False

    def out() -> Iterator[pa.RecordBatch]:
        if learnt:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in state)], ["shard", "z", "n"])

    for b in some(batches):
        texts, labels = utf8(b["text"]), b["label"].to_pylist()
        for i, shard in enumerate(b["shard"].to_pylist()):
            if shard != now:
                yield from out()
                now, learnt = shard, False
                state = tuple(_array(b[k][i]).copy() if b[k][i].is_valid else np.zeros(DIM) for k in ("z", "n"))
            if labels[i] is not None:
                learn(*state, *features(texts[i], words), labels[i])
                learnt = True
    yield from out()


def train(rows: DataFrame, passes: int = PASSES) -> np.ndarray:
    """Weights from (shard, order, text, label). Each pass starts from the mean of the shards' states after the last, a table of one
    row of a fixed size; only the weights come to the driver."""
    rows = materialize(rows.select("shard", "order", "text", "label"), "sample")
    none, state = [F.lit(None).cast("binary").alias(k) for k in ("z", "n")], None
    for _ in range(passes):
        every = rows.select("*", *none)
        if state is not None:
            every = every.unionByName(state.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARDS - 1).cast("long"))).alias("shard"), "z", "n"), allowMissingColumns=True)
        dealt = every.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.col("label").isNotNull(), "order", F.xxhash64("text"))
        states = dealt.mapInArrow(_pass, "shard long, z binary, n binary").repartition(1)
        state = materialize(states.mapInArrow(_mean, "z binary, n binary"), "state")
    found = [] if state is None else state.mapInArrow(_weights, "w binary").collect()
    return np.frombuffer(found[0]["w"]).copy() if found else np.zeros(DIM)


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """`docs` with each row's score as a last column named `__score`."""
    model = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in some(batches):
            scores = []
            for text in utf8(b["text"]):
                index, value = features(text, words)
                scores.append(1 / (1 + np.exp(-float(np.clip(model.value[index] @ value, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "__score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))


def _model(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return train(training_sample(docs, labels, fold("doc_id", FOLDS) != HELD))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier takes for good, with all columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return materialize(score(rows, _model(docs, labels)).where("__score >= 0.5").select("row.*"), "good")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = materialize(score(docs, _model(docs, table(spark, sf_dir, "labels"))).select("doc_id", "__score"), "scores")
    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))

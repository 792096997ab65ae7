"""Language-model scores by context-tree weighting.

A byte is eight binary decisions, a path in a tree of 255 nodes. For each of the last 0 to DEPTH bytes as context, a node
has a Krichevsky-Trofimov estimate from its counts over the training texts. Weighting mixes the estimates of all depths:
a node's share is its own sequence's probability against the product of its children's. Counts and shares are computed
bottom-up and mixtures top-down, level by level, as grouped tables of all contexts in the corpus; a context that training
never saw has counts of zero, and so an estimate of one half. A text's score is the log10 probability of its bytes, A-Z
in lower case, and an end mark (byte 255, which no UTF-8 text holds).

What is gathered grows with the corpus: the counts, the mixture, and a value for each sequence of a context and a byte.
What a task holds is bounded: the values of the KEPT most frequent sequences, and of KNOWN words. It looks up its texts'
sequences there by their whole keys; what it doesn't find it emits, and equality joins with the tables give the rest.

Defined results: a null text is empty and scores its end mark alone; a null doc_id is in no fold, learnt from and not
held out; each of repeated rows counts and is scored; of words or sequences that tie in frequency either all or none are
held by tasks, which changes no score; very long texts are scored whole, in blocks; without training rows all estimates
are one half and no word is known; an empty table gives an empty result; other columns, whatever their names, are left
out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold, materialize, partitions, some, table, texts, utf8

#: Bytes of context; and sequences whose values tasks hold.
DEPTH, KEPT = 5, 1 << 20
#: Words, of at most so many bytes, whose counts the scoring tasks hold.
KNOWN, WORD = 1 << 17, 64
MARK = 255
#: The registered query learns from documents whose crc32 of the id leaves another remainder by FOLDS than HELD.
FOLDS, HELD = 7, 2
#: Bytes of texts that are read at once and looked up at once, and sequences that a task gathers before it passes them on.
BLOCK, PART, GATHER = 1 << 19, 1 << 16, 1 << 22
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)
#: No sequence: contexts of at most 6 bytes leave its first byte zero.
NONE = U(0xFFFFFFFFFFFFFFFF)


def sequences(docs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and their end marks, with the `depth` bytes before it, as one number; and where each text starts."""
    pad = bytes([MARK]) * depth
    joined = np.frombuffer(b"".join(pad + d + bytes([MARK]) for d in docs), np.uint8).astype(np.uint64)
    size = np.array([len(d) + 1 for d in docs])
    start = np.cumsum(size) - size
    keys = joined[depth:].copy()
    for back in range(1, depth + 1):
        keys |= joined[depth - back : len(joined) - back] << U(8 * back)
    # between two texts are `depth` places of padding
    return keys[np.arange(size.sum()) + np.repeat(np.arange(len(docs)) * depth, size)], start


def blocks(docs: list[bytes]) -> Iterator[list[int]]:
    """The texts' numbers, in lists of about BLOCK bytes."""
    held, size = [], 0
    for i, d in enumerate(docs):
        if held and size + len(d) > BLOCK:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(d)
    if held:
        yield held


def corpus_counts(docs: DataFrame, use: Column, depth: int = DEPTH) -> DataFrame:
    """(seq, word, n, every): how often each byte sequence and each word (the other is null) is in the texts that `use` allows, and in all; texts' ends count as an empty word, and words of other texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: dict[bool, list] = {True: [], False: []}
        names = ["seq", "word", "n", "every"]

        def of_words():
            n = pa.array(list(words.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), n, n], names)

        def of_sequences(used: bool):
            keys, n = np.unique(np.concatenate(held[used]), return_counts=True)
            held[used] = []
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n * used), pa.array(n)], names)

        for b in some(batches):
            docs, use = [t.lower() for t in utf8(b["text"])], b["use"].to_pylist()
            for used in (True, False):
                mine = [d for d, u in zip(docs, use, strict=True) if bool(u) is used]
                for some_docs in blocks(mine):
                    held[used].append(sequences([mine[i] for i in some_docs], depth)[0])
                    if sum(map(len, held[used])) > GATHER:
                        yield of_sequences(used)
                for d in mine if used else ():
                    words.update(d.split())
                if used and mine:
                    words[b""] += len(mine)
            if len(words) > 150_000:
                yield of_words()
                words = Counter()
        if words:
            yield of_words()
        for used in (True, False):
            if held[used]:
                yield of_sequences(used)

    rows = docs.select("text", use.alias("use")).mapInArrow(run, "seq long, word binary, n long, every long")
    return rows.groupBy("seq", "word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, seven steps up; exact to about 1e-11 for x >= 0.5."""
    y = x + 7
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - F.log(product)


def _kt(zeros: str, ones: str) -> Column:
    """The log probability that sequential Krichevsky-Trofimov estimates give so many zeros and ones."""
    a, b = F.col(zeros).cast("double"), F.col(ones).cast("double")
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)


def tree(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth a table (ctx, node, zeros, ones, own, log_p): counts, and the weight of the node's own estimate against its children's mixture. The deepest also has how often all texts hold its two bits."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")
    leaf = counts.where("seq is not null").select(F.shiftrightunsigned("seq", 8).alias("ctx"), F.col("seq").bitwiseAND(F.lit(255)).alias("byte"), "n", "every", bits)
    node = F.expr("cast(shiftleft(1, bit) + shiftright(byte, 8 - bit) as int)").alias("node")
    one = F.expr("shiftright(byte, 7 - bit) & 1") == 1
    split = lambda c: (F.sum(F.when(one, 0).otherwise(F.col(c))), F.sum(F.when(one, F.col(c)).otherwise(0)))
    (zeros, ones), (all0, all1) = split("n"), split("every")
    level = leaf.groupBy("ctx", node).agg(zeros.alias("zeros"), ones.alias("ones"), all0.alias("all0"), all1.alias("all1"))
    level = materialize(level.withColumn("own", F.lit(1.0)).withColumn("log_p", _kt("zeros", "ones")), "contexts")
    out = [level]
    for d in range(depth - 1, -1, -1):
        up = level.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("ctx"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_p").alias("children"))
        own = _kt("zeros", "ones")
        up = up.withColumn("kt", own).withColumn("own", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("children") - F.col("kt"))))))
        most, least = F.greatest("kt", "children"), F.least("kt", "children")
        level = materialize(up.withColumn("log_p", most + F.log1p(F.exp(least - most)) - math.log(2)).select("ctx", "node", "zeros", "ones", "own", "log_p"), "contexts")
        out.append(level)
    return out[::-1]


def mixture(levels: list[DataFrame]) -> DataFrame:
    """(ctx, node, p, all0, all1) of the deepest contexts: the mixed probability of a one over all depths."""
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    above = levels[0].select("ctx", "node", (F.col("own") * estimate).alias("p"), (1 - F.col("own")).alias("rest"))
    for d, level in enumerate(levels[1:], 1):
        up = above.select(F.col("ctx").alias("up"), F.col("node").alias("of"), F.col("p").alias("above"), "rest")
        met = level.join(up, (level["ctx"].bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1)) == up["up"]) & (level["node"] == up["of"]))
        more = ["all0", "all1"] if d == len(levels) - 1 else []
        above = met.select("ctx", "node", (F.col("above") + F.col("rest") * F.col("own") * estimate).alias("p"), (F.col("rest") * (1 - F.col("own"))).alias("rest"), *more)
        if d < len(levels) - 1:
            above = materialize(above, "mixture")
    return above.drop("rest")


def values(mixed: DataFrame) -> DataFrame:
    """(seq, every, value): the log10 probability of the byte of each sequence in the corpus after its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            ctx, node, p, all0, all1 = (np.concatenate([r[i] for r in rows]) for i in range(5))
            # nodes of a context are next to each other and in order: an ancestor is found among them
            key = (ctx.view(np.uint64) << U(8)) | node.astype(np.uint64)
            last = np.nonzero(node >= 128)[0]
            total = np.zeros(len(last))
            for up in range(1, 8):
                at = np.searchsorted(key, (ctx[last].view(np.uint64) << U(8)) | (node[last].astype(np.uint64) >> U(up)))
                bit = (node[last] >> (up - 1)) & 1
                total += np.log10(np.where(bit == 1, p[at], 1 - p[at]))
            for bit, every in ((0, all0), (1, all1)):
                here = every[last] > 0
                seq = (ctx[last] << 8) | ((node[last].astype(np.int64) - 128) * 2 + bit)
                value = total + np.log10(p[last] if bit else 1 - p[last])
                yield pa.RecordBatch.from_arrays([pa.array(seq[here]), pa.array(every[last][here]), pa.array(value[here])], ["seq", "every", "value"])

        for b in batches:
            rows = [b[k].to_numpy(zero_copy_only=False) for k in ("ctx", "node", "p", "all0", "all1")]
            # whole contexts, which have at most 255 rows, are done; the last may go on
            ends = np.nonzero(np.diff(rows[0]))[0] + 1
            if not len(ends):
                kept.append(rows)
                continue
            yield from out([*kept, [r[: ends[-1]] for r in rows]])
            kept = [[r[ends[-1] :] for r in rows]]
        if kept and len(kept[0][0]):
            yield from out(kept)

    dealt = mixed.repartition(partitions(mixed.sparkSession), "ctx").sortWithinPartitions("ctx", "node")
    return dealt.select("ctx", "node", "p", "all0", "all1").mapInArrow(run, "seq long, every long, value double")


def kept_values(of: DataFrame, most: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, values), the most frequent last, of the most frequent sequences, by whole steps of frequency, so that there are at most `most` of them."""
    steps = of.withColumn("step", F.floor(F.log2(F.col("every").cast("double")) * 16))
    least = _last_step(steps, most)
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    t = steps.where(F.col("step") >= least).select("seq", "value", "step").toArrow()
    order = np.argsort(t["step"].to_numpy(), kind="stable")
    return t["seq"].to_numpy().view(np.uint64)[order], t["value"].to_numpy()[order]


def _last_step(rows: DataFrame, most: int) -> int | None:
    """The least step down to which there are at most `most` rows."""
    total, least = 0, None
    for step, n in sorted(rows.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = step
    return least


def known_words(words: DataFrame, most: int = KNOWN) -> dict[bytes, int]:
    """The most frequent words, by whole steps of frequency, so that there are at most `most` of them."""
    short = words.where(F.length("word") <= WORD).withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 16))
    least = _last_step(short, most)
    if least is None:
        return {}
    t = short.where(F.col("step") >= least).select("word", "n").toArrow()
    return dict(zip(t["word"].to_pylist(), t["n"].to_pylist(), strict=True))


class Lookup:
    """Values of sequences, found by whole keys: a table of slots finds most, a binary search the others."""

    def __init__(self, seq: np.ndarray, value: np.ndarray):
        order = np.argsort(seq)
        self.seq, self.value = np.append(seq[order], NONE), np.append(value[order], 0.0)
        bits = max(4, len(self.seq).bit_length())
        self.shift = U(64 - bits)
        self.key, self.worth = np.full(1 << bits, NONE), np.zeros(1 << bits)
        at = self.place(seq)
        self.key[at], self.worth[at] = seq, value  # of several in a slot, the last and so most frequent stays in both

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; the numbers of the keys that aren't held)."""
        at = self.place(keys)
        out, miss = self.worth[at], np.flatnonzero(self.key[at] != keys)
        if len(miss):
            at = np.searchsorted(self.seq[:-1], keys[miss])
            found = self.seq[at] == keys[miss]
            out[miss] = np.where(found, self.value[at], 0.0)
            miss = miss[~found]
        return out, miss


def score(docs: DataFrame, kept: tuple[np.ndarray, np.ndarray], known: dict[bytes, int], depth: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, logs, rare, score, open) for (doc_id, text): of words in `known` the number and the sum of log10(count + 1), the others with their number; of sequences in `kept` the sum of values, the others with their number."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((kept, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (seq, value), words = model.value
        look, of = Lookup(seq, value), {w: math.log10(n + 1) for w, n in words.items()}
        for b in some(batches, 500):
            docs = [x.lower() for x in utf8(b["text"])]
            scores, rest = np.zeros(len(docs)), [[] for _ in docs]
            for block in blocks(docs):
                keys, start = sequences([docs[i] for i in block], depth)
                p = np.empty(len(keys))
                for at in range(0, len(keys), PART):
                    p[at : at + PART], miss = look(keys[at : at + PART])
                    if not len(miss):
                        continue
                    owner = np.searchsorted(start, miss + at, "right") - 1
                    for i in np.unique(owner).tolist():
                        rest[block[i]].append(keys[at + miss[owner == i]])
                scores[block] = np.add.reduceat(p, start)
            out = []
            for d, miss in zip(docs, rest, strict=True):
                c = Counter(d.split())
                total, seen, logs, rare = sum(c.values()) + 1, 0, 0.0, []
                c[b""] += 1
                for w, n in c.items():
                    log = of.get(w)
                    if log is None:
                        rare.append({"word": w, "n": n})
                    else:
                        seen += n
                        logs += n * log
                seq, times = np.unique(np.concatenate(miss), return_counts=True) if miss else ((), ())
                out.append((total, seen, logs, rare, [{"seq": s, "n": n} for s, n in zip(np.asarray(seq, np.uint64).view(np.int64).tolist(), list(times), strict=True)], len(d)))
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])), pa.list_(pa.struct([("seq", pa.int64()), ("n", pa.int64())])), pa.int64())
            names = ["doc_id", "n_tokens", "n_known", "logs", "rare", "open", "n_bytes", "score"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(scores)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, logs double, rare array<struct<word: binary, n: long>>, open array<struct<seq: long, n: long>>, n_bytes long, score double")


def lm_scores(docs: DataFrame, held: Column, depth: int = DEPTH, kept: int = KEPT, most: int = KNOWN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for all rows of `docs`, learning from those that are not `held`; `bits_per_byte` is the model's code length, the end mark counted as a byte."""
    docs = texts(docs)
    counts = materialize(corpus_counts(docs, ~held, depth), "counts")
    words = counts.where("word is not null").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    levels = tree(counts, depth)
    of = materialize(values(mixture(levels)), "values")
    discard(*levels)
    rows = score(docs, kept_values(of, kept), known_words(words, most), depth).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "scores")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    more = rare.join(words, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    open_ = rows.select("row", F.explode("open").alias("o")).select("row", F.col("o.seq").alias("seq"), F.col("o.n").alias("times"))
    rest = open_.join(of, "seq").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest"))
    out = rows.drop("rare", "open").join(more, "row", "left").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * math.log10(total + distinct + 1)
    n_known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    whole = F.col("score") + F.coalesce("rest", F.lit(0.0))
    bits = -whole / math.log10(2) / (F.col("n_bytes") + 1)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"), bits.alias("bits_per_byte"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)))

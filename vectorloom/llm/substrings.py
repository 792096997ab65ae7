"""Removal of repeated byte strings, by a distributed merge sort of the suffixes that can repeat.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Every start of such a string has an
anchor, the least hash among the first WINDOW positions of the string, which follows from the string's bytes alone; so
two equal strings have equal anchors at equal distances, and share at least SPAN - WINDOW + 1 bytes from there on.

1. Whole copies are found by digest: a text that occurs twice loses all its bytes if it has SPAN of them, and goes on as
   one text.
2. Anchors whose next SPAN - WINDOW + 1 bytes occur once can't belong to a repeat. The others' suffixes, SPAN bytes each,
   are sorted in runs, front-coded, and exchanged: a bucket gets all suffixes that start with the same bytes.
3. A bucket merges its runs by a loser tree that knows the common prefixes of neighbours. For each distance of a start
   before its anchor, suffixes that share SPAN less the distance, and whose bytes before the anchor agree over the
   distance, are equal strings: both are intervals of a sorted order, so no pair is compared.
4. The starts of anchors with very many places, which no task should have together, are grouped by 127 bits of their
   strings' hashes instead.
5. Starts that were found cover SPAN bytes each, which are cut out of the texts.

In a run, suffixes with equal surroundings are one: what a large group of copies or a common passage has in one task
costs one row. Buckets are merged in blocks that share too little with their neighbours to match them.

Defined results: a null text is empty; texts shorter than SPAN lose nothing; each of repeated rows counts as a
document, so long ones lose all bytes, and so do texts that tie; very long texts are read whole, and what a row holds of
one, its anchors and spans, grows as the text; an empty table gives an empty result; other columns, whatever their names,
are left out. The query's `text` is what is left, with a replacement character where a cut went through a character.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, some, table, texts
from .suffixes import front_code, merge, shared_with_before

SPAN, WINDOW, GRAM = 400, 200, 16
#: Suffixes of a sorted run, suffixes that a bucket has on average, and suffixes that are matched at once.
RUN, BUCKET, MATCH = 20_000, 100_000, 20_000
#: Anchors with more places than this are not sorted: their starts are grouped by the hash of their strings.
COMMON = 50_000
#: Rows, of a few dozen bytes, that may be broadcast; more are joined by a shuffle.
SMALL = 500_000
PIECE = 1 << 20
U = np.uint64
META = "<qqIHHB"
META_SIZE = struct.calcsize(META)


def anchors(text: bytes, span: int = SPAN, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of all starts of strings of `span` bytes, by anchor."""
    n = len(text) - span + 1
    out: list[list[np.ndarray]] = [[], [], []]
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in out)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)
        part = data[at : at + m + window - 1 + gram - 1].astype(np.uint64)
        h = np.zeros(len(part) - gram + 1, np.uint64)
        for i in range(gram):
            h = h * U(0x100000001B3) + part[i : len(part) - gram + 1 + i] * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
        h *= U(0xC4CEB9FE1A85EC53)
        # the least hash's leftmost place: 32 bits of hash, then the place
        best, width = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= window:
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        if width < window:
            best = np.minimum(best[: m], best[window - width : window - width + m])
        a = (best[:m] & U(0xFFFFFFFF)).astype(np.int64) + at
        new = np.nonzero(np.diff(a))[0] + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [m - 1]))
        for k, v in zip(out, (a[first], first + at, last + at), strict=True):
            k.append(v)
    a, first, last = (np.concatenate(k) for k in out)
    if len(out[0]) > 1:  # an anchor whose starts two pieces share
        same = np.concatenate(([False], a[1:] == a[:-1]))
        last = np.append(last[:-1], last[-1])
        keep = ~same
        ends = np.append(np.nonzero(keep)[0][1:] - 1, len(a) - 1)
        a, first, last = a[keep], first[keep], last[ends]
    return a, first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): 128 bits that name a text."""
    return texts(docs).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(5), F.col("text")))


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df.hint("shuffle_hash")


def _anchor_rows(docs: DataFrame, span: int, window: int) -> DataFrame:
    """(h, k1, k2, a, first, last): an anchor, its starts, and the hash of the bytes that all of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in some(batches):
            columns: list[list] = [[] for _ in range(6)]
            for k1, k2, text in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                a, first, last = anchors(text, span, window)
                if len(a):
                    core = span - window + 1
                    columns[0].append(np.array([digest(text[x : x + core]) for x in a.tolist()], np.uint64).view(np.int64))
                    for c, v in zip(columns[1:], (np.full(len(a), k1), np.full(len(a), k2), a, first, last), strict=True):
                        c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h", "k1", "k2", "a", "first", "last"])

    return docs.where(F.octet_length("text") >= span).select("k1", "k2", "text").mapInArrow(run, "h long, k1 long, k2 long, a long, first long, last long")


def _runs(candidates: DataFrame, buckets: int, span: int) -> DataFrame:
    """Sorted, front-coded runs as (bucket, run); what a run has found by itself as (k1, k2, start, end); and the starts of
    common anchors, which are not sorted, as (k1, k2, start, h1, h2, n) by their strings' hash."""
    names = ["bucket", "run", "k1", "k2", "start", "end", "h1", "h2", "n"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 7]

    def out(records: dict) -> Iterator[tuple]:
        # suffixes with equal surroundings are one, and the starts of all of them repeat
        by_bucket: dict[int, list] = {}
        for (right, left, lo, hi, h, common), members in records.items():
            if len(members) > 1:
                for k1, k2, a in members:
                    yield None, None, k1, k2, a - hi, a - lo + span, None, None, None
            k1, k2, a = members[0]
            if common:
                around, many = left[::-1] + right, 1 + (len(members) > 1)
                for d in range(lo, hi + 1):
                    x = xxhash.xxh3_128_intdigest(around[hi - d : hi - d + span])
                    yield None, None, k1, k2, a - d, None, (x >> 65), x & (1 << 63) - 1, many
            else:
                by_bucket.setdefault((h >> 3) % buckets, []).append((right, struct.pack(META, k1, k2, a, lo, hi, len(members) > 1) + left))
        for bucket, rows in by_bucket.items():
            rows.sort()
            yield bucket, front_code([r[0] for r in rows], [r[1] for r in rows]), *[None] * 7

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(rows, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, n = {}, 0
        for b in some(batches):
            for k1, k2, text, found in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["found"].to_pylist(), strict=True):
                for x in found:
                    a, hi, lo = x["a"], x["a"] - x["first"], x["a"] - x["last"]
                    key = (text[a : a + span], text[a - hi : a][::-1], lo, hi, x["h"], x["common"])
                    records.setdefault(key, []).append((k1, k2, a))
                    n += 1
                if n >= RUN:
                    yield from batched(out(records))
                    records, n = {}, 0
        yield from batched(out(records))

    return candidates.mapInArrow(run, ", ".join(f"{n} {'binary' if k == pa.binary() else 'long'}" for n, k in zip(names, kinds, strict=True)))


def match(rights: list[bytes], shared: np.ndarray, lefts: list[bytes], lo: np.ndarray, hi: np.ndarray, many: np.ndarray, span: int, window: int) -> np.ndarray:
    """Which starts repeat: a table of suffixes (in order, `shared` bytes with the one before) by distances 0 to window - 1 before the anchor."""
    n = len(rights)
    order = sorted(range(n), key=lefts.__getitem__)
    alike = shared_with_before([lefts[i] for i in order])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found = np.zeros((n, window), bool)
    weight = 1 + many.astype(np.int64)
    for d in range(window):
        mine = np.nonzero((lo <= d) & (d <= hi))[0]
        if not len(mine):
            continue
        right = np.cumsum(shared < span - d)[mine]
        left = np.cumsum(alike < d)[place[mine]]
        group, of = np.unique(right * (n + 1) + left, return_inverse=True)
        found[mine, d] = np.bincount(of, weight[mine], len(group))[of] > 1
    return found


def _matches(runs: DataFrame, span: int, window: int) -> DataFrame:
    """(k1, k2, start, end) of covered bytes, from the runs of each bucket."""

    def resolve(block: list) -> list[tuple]:
        if len(block) < 2:
            return []
        meta = [struct.unpack_from(META, e) for _, _, e in block]
        lefts = [e[META_SIZE :] for _, _, e in block]
        lo, hi, many = (np.array([m[i] for m in meta]) for i in (3, 4, 5))
        found = match([s for _, s, _ in block], np.array([n for n, _, _ in block]), lefts, lo, hi, many, span, window)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return [(*meta[r][:2], meta[r][2] - int(e) + 1, meta[r][2] - int(s) + span) for r, s, e in zip(i.tolist(), begin, end, strict=True)]

    def bucket(runs: list[bytes]) -> Iterator[tuple]:
        block: list = []
        for known, suffix, extra in merge(runs):
            if len(block) >= MATCH and known < span - window + 1:
                yield from resolve(block)
                block = []
            block.append((known, suffix, extra))
        yield from resolve(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            rows = list(bucket(held))
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "start", "end"])

        for b in some(batches):
            for k, r in zip(b["bucket"].to_pylist(), b["run"].to_pylist(), strict=True):
                if k != now:
                    yield from out()
                    now, held = k, []
                held.append(r)
        yield from out()

    dealt = runs.repartition(partitions(runs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "k1 long, k2 long, start long, end long")


def _cut(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text, spans): `kept` has the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            rows = []
            for text, spans in zip(b["text"].cast(pa.binary()).to_pylist(), b["spans"].to_pylist(), strict=True):
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, [s["start"] for s in spans], 1)
                np.add.at(step, [s["end"] for s in spans], -1)
                gone = np.cumsum(step[:-1]) > 0
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), n_spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_spans(docs: DataFrame, span: int = SPAN, window: int = WINDOW, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(k1, k2) of texts of at least `span` bytes that occur more than once, and (k1, k2, spans) of texts in which bytes repeat: arrays of (start, end)."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    texts_of = materialize(keyed.where(F.octet_length("text") >= span).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "texts")
    rows = _anchor_rows(keyed, span, window).groupBy("h", "k1", "k2", "a").agg(F.first("first").alias("first"), F.first("last").alias("last"))
    rows = materialize(rows, "anchors")
    again = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > common).alias("common")), "repeated")
    n_again = again.count()
    of_text = rows.join(F.broadcast(again) if n_again <= SMALL else again, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "a", "first", "last", "common")).alias("found"))
    of_text = materialize(of_text.join(texts_of.select("k1", "k2", "least"), ["k1", "k2"]), "candidates")
    discard(rows, again)
    n_found = of_text.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-n_found // BUCKET))
    # one row of each text goes on; should a row be there twice, it matches itself, and as a copy it goes anyway
    one = keyed.join(_near(of_text, n_found), ["k1", "k2"]).where("doc_id <=> least").select("k1", "k2", "text", "found")
    runs = materialize(_runs(one, buckets, span), "runs")
    discard(of_text)
    alone = runs.where("end is not null").select("k1", "k2", "start", "end")
    loose = runs.where("h1 is not null")
    met = loose.join(loose.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("h1", "h2"), ["h1", "h2"])
    met = met.select("k1", "k2", "start", (F.col("start") + span).alias("end"))
    spans = _matches(runs.where("bucket is not null").select("bucket", "run"), span, window).unionByName(alone).unionByName(met)
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(runs)
    return texts_of.where("n > 1").select("k1", "k2"), spans


def remove_repeats(docs: DataFrame, span: int = SPAN, window: int = WINDOW, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: `kept` has the bytes that stay."""
    copies, spans = repeated_spans(docs, span, window, common)
    n_copies = copies.count()
    n_spans = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    both = _keyed(docs).join(_near(copies.withColumn("copied", F.lit(True)), n_copies), ["k1", "k2"], "left").join(_near(spans, n_spans), ["k1", "k2"], "left")
    size, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    gone = F.col("copied").isNotNull()
    plain = both.where(gone | F.col("spans").isNull()).select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(none).alias("n_removed"), F.when(gone, 1).otherwise(none).alias("n_spans"), F.when(gone, F.lit(b"")).otherwise(F.encode("text", "UTF-8")).alias("kept"))
    return plain.unionByName(_cut(both.where(~gone & F.col("spans").isNotNull())))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), text)

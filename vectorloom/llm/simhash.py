"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint is cut into segments. Fingerprints that differ in few bits have a segment that differs in at most one, so
both of them own the variant of that segment in which the differing bit is a wildcard. The one-wildcard variants of all
segments of each distinct fingerprint are its signatures; an equality join on them finds candidates, which are verified.

`simhash_groups` links 64-bit fingerprints that differ in at most three bits. Two segments of 32 bits find all of them.
A signature that more than CROWD fingerprints share is split by the rest of the fingerprint in the same way: a half of
the rest again differs in at most one bit, so its one-wildcard variants extend the signature, and so on until the eight
bits that are left bound the fingerprints that a signature can have.

`similar_groups` links texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, which is about a
tenth of the bits: WIDE segments of WIDE_BITS bits of the two-word shingles' SimHash find candidates, and the sets
themselves decide: each member of a signature is compared with its least one, in work that is linear however many share
it. Links between texts that these leave apart are found by an exact join. In one order of all shingles, rare ones first,
similar sets share one of their first shingles, as many as a similar set can lack, and one more; what such a pair can have
in common is bounded by the shingle's places in both, and by the parities of BITS classes of shingles. Only pairs that
these bounds exclude are left out, so no link is lost.

Defined results: a null text is empty; texts without words have fingerprint zero, which links like any other; ties and
repeated rows are in one group, and repeats of its least doc_id all stay; of a null doc_id, `simhash_groups` gives the
least id of its component, and the dedups keep its row; very long texts are read whole, in blocks; an empty table gives
an empty result; other columns, whatever their names, are kept by the dedups and left out by the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, discard, join_hot, keep_ids, materialize, some, table, texts, utf8
from .components import components

SHINGLE, SEED, NEAR, SEGMENT = 3, 42, 3, 32
#: A signature that more fingerprints share is split by further bits.
CROWD = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 13

#: The similarity of texts: five-word shingles, and the least Jaccard similarity as a fraction.
WORDS, P, Q = 5, 4, 5
#: Segments and their bits, of the SimHash of PAIR-word shingles that finds candidates.
PAIR, WIDE, WIDE_BITS = 2, 12, 24
#: Bits in which candidates may differ from a signature's least member: other pairs are left to the exact join.
FAR = 44
#: Parities of a set; slots in which shingles are counted, of which a task tells the fullest, and of which so many are known.
BITS, SLOTS, TELLS, KNOWN = 1024, 20, 4096, 65_536
#: Members of a shingle that one task compares with all others.
SHARE = 4096
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, in blocks."""
    words = text.lower().split()
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: a bit is set if over half of its shingles' XXH64 have it."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle, seed):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in utf8(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    docs = texts(docs)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# ---- links of 64-bit fingerprints -----------------------------------------------------------------------------------


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1)


def _variants(rows: DataFrame, bits: int) -> DataFrame:
    """Cut `rest`, of 2 * bits bits, in halves: a row for each half and wildcard, whose `key` has that variant and whose `rest` is the other half."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(2 * bits - 1))).alias("bit")
    rows = rows.select("key", "rest", "fp", bit)
    low, high = F.col("rest").bitwiseAND(_mask(bits)), F.shiftrightunsigned("rest", bits).bitwiseAND(_mask(bits))
    mine, other = F.when(F.col("bit") < bits, low).otherwise(high), F.when(F.col("bit") < bits, high).otherwise(low)
    masked = mine.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, cast(bit % {bits} as int))")))
    return rows.select(F.concat("key", F.array(F.col("bit").cast("long") * F.lit(1 << bits) + masked)).alias("key"), other.alias("rest"), "fp")


def _links(fps: DataFrame, near: int, crowd: int) -> DataFrame:
    """(src, dst) edges between distinct fingerprints: all that differ in at most `near` bits, and no others, each once or more."""
    rows, found = fps.select(F.array().cast("array<bigint>").alias("key"), F.col("fp").alias("rest"), "fp"), None
    for bits in (SEGMENT, SEGMENT // 2, SEGMENT // 4):
        shared = _variants(rows, bits).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
        shared = materialize(shared, "signatures")
        few = shared if bits == SEGMENT // 4 else shared.where(f"n <= {crowd}")
        a, b = few.select("key", "fp"), few.select("key", F.col("fp").alias("fp2"))
        close = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= near)
        links = a.join(b, (a["key"] == b["key"]) & close).select(F.col("fp").alias("src"), F.col("fp2").alias("dst"))
        found = links if found is None else found.union(links)
        rows = shared.where(f"n > {crowd}")
        if bits == SEGMENT // 4 or rows.isEmpty():
            break
    return found


def simhash_groups(docs: DataFrame, near: int = NEAR, crowd: int = CROWD, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id); component_id is the least doc_id reachable over links of at most `near` bits.

    `near` can be 2 or 3: with more, a segment may differ in two bits.
    """
    if near not in (2, 3):
        raise ValueError("near must be 2 or 3")
    fps = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    links = materialize(_links(least.select("fp"), near, crowd), "links")
    roots = components(links).join(least.select(F.col("fp").alias("node"), "least"), "node")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    of = materialize(least.join(of, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    return join_hot(fps, of, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, near: int = NEAR, crowd: int = CROWD) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its component of fingerprints; all columns stay. Needs unique ids; rows of a null id stay."""
    lost = simhash_groups(docs, near, crowd).where("doc_id <> component_id").select("doc_id")
    return keep_ids(docs, lost)


# ---- links of similar texts -----------------------------------------------------------------------------------------


class Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out

    def of(self, text: bytes) -> np.ndarray:
        """The hashes of a text's words, letters in lower case."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's n-word shingles, from its words'; fewer words are one shingle, no words none."""
    n = min(n, len(words))
    h = np.full(max(0, len(words) - n + 1) if n else 0, n, np.uint64)
    for i in range(n):
        h = h * STEP + words[i : i + len(h)]
    return np.unique(_mix(h))


def wide_fingerprint(words: np.ndarray, bits: int = WIDE * WIDE_BITS) -> np.ndarray:
    """The bits of a text's SimHash over its distinct PAIR-word shingles."""
    h = shingle_set(words, PAIR)
    ones, salts = np.zeros(bits, np.int64), np.arange(-(-bits // 64), dtype=np.uint64) * STEP
    for at in range(0, len(h), BLOCK):
        rows = _mix(h[at : at + BLOCK, None] + salts).view(np.uint8)[:, : bits // 8]
        ones += np.unpackbits(rows, axis=1).sum(0, dtype=np.uint16)  # a block has fewer rows than 2 ** 16
    return (2 * ones > len(h)).astype(np.uint8)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, segments, slots, counts): the digest and size of each text's set of shingles, and the segments of its
    fingerprint; and a row a task, whose `slots` isn't null, with the slots that have most of its shingles."""
    place = np.int64(1) << np.arange(WIDE_BITS)
    longs, kind = pa.list_(pa.int64()), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, n, ids = Words(), np.zeros(1 << SLOTS, np.int64), 0, None

        def out(doc_id, digest, size, segments, slots, counts):
            return pa.RecordBatch.from_arrays([doc_id, pa.array(digest, pa.binary()), pa.array(size, pa.int64()), *(pa.array(x, longs) for x in (segments, slots, counts))], ["doc_id", "digest", "size", "segments", "slots", "counts"])

        for b in some(batches):
            digest, size, segments = [], [], []
            for t in utf8(b["text"]):
                words = known.of(t)
                h = shingle_set(words)
                counts[h >> U(64 - SLOTS)] += 1
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                segments.append(wide_fingerprint(words).reshape(WIDE, WIDE_BITS) @ place)
            n, ids, none = n + b.num_rows, b["doc_id"].type, [None] * b.num_rows
            yield out(b["doc_id"], digest, size, segments, none, none)
        if n:
            full = np.flatnonzero(counts > 2 + n // 256)
            full = full[np.argsort(-counts[full], kind="stable")[:TELLS]]
            yield out(pa.nulls(1, ids), [None], [None], [None], [full], [counts[full]])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, size long, segments array<long>, slots array<long>, counts array<long>")


def _crowds(sketches: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are, as a power of two, or 0. This orders shingles, so that few sets share their first ones; links don't depend on it."""
    told = sketches.where("slots is not null").select(F.explode(F.arrays_zip("slots", "counts")).alias("of"))
    told = told.groupBy(F.col("of.slots").alias("slot")).agg(F.sum("of.counts").alias("n")).orderBy(F.desc("n"), "slot").limit(KNOWN)
    out = np.zeros(1 << SLOTS, np.uint8)
    for r in told.collect():
        out[r["slot"]] = r["n"].bit_length()
    return out


def _firsts(docs: DataFrame, crowds: np.ndarray) -> DataFrame:
    """(node, size, parities, firsts): each text's first shingles, by which a similar one is found, and the parities of how many of its shingles are in each class."""
    crowds = docs.sparkSession.sparkContext.broadcast(crowds)  # a fixed number of slots
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in some(batches):
            size, parities, firsts = [], [], []
            for t in utf8(b["text"]):
                h = shingle_set(known.of(t))
                order = np.argsort(crowds.value[h >> U(64 - SLOTS)], kind="stable")
                size.append(len(h))
                odd = np.bincount((h & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                firsts.append(h[order[: len(h) + P * len(h) // -Q + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(parities, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], ["node", "size", "parities", "firsts"])

    return docs.mapInArrow(run, f"node {kind}, size long, parities array<long>, firsts array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, hashes): the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in some(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([shingle_set(known.of(t)).tobytes() for t in utf8(b["text"])], pa.binary())], ["node", "hashes"])

    return docs.mapInArrow(run, f"node {docs.schema['doc_id'].dataType.simpleString()}, hashes binary")


def fold_parities(hashes: np.ndarray) -> bytes:
    """The parities of how many of a set's hashes are in each class of their last bits; there are as many classes as hashes, or up to twice as many."""
    bits = max(8, 1 << int(len(hashes) - 1).bit_length()) if len(hashes) else 8
    return np.packbits((np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def parities_differ(x: bytes, y: bytes) -> int:
    """How many parities differ, in the classes of the smaller set: so many hashes at least are in one set alone."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _parities(sets: DataFrame) -> DataFrame:
    """(node, size, parities) of the sets (node, hashes): about a fiftieth of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in b["hashes"]]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([len(h) for h in hashes], pa.int64()), pa.array([fold_parities(h) for h in hashes], pa.binary())], ["node", "size", "parities"])

    return sets.mapInArrow(run, f"node {sets.schema['node'].dataType.simpleString()}, size long, parities binary")


def _not_excluded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (src, dst) those that sizes and parities of the sets don't exclude, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            m, n = (b[k].to_numpy() for k in ("m", "n"))
            fits = np.minimum(m, n) * Q >= np.maximum(m, n) * P
            for i in np.flatnonzero(fits):
                fits[i] = parities_differ(b["x"][i].as_py(), b["y"][i].as_py()) * (P + Q) <= (m[i] + n[i]) * (Q - P)
            yield b.select(["src", "dst"]).filter(pa.array(fits, pa.bool_()))

    marks, kind = materialize(_parities(sets), "parities"), pairs.schema["src"].dataType.simpleString()
    x, y = (marks.select(F.col("node").alias(end), F.col("size").alias(n), F.col("parities").alias(p)) for end, n, p in (("src", "m", "x"), ("dst", "n", "y")))
    out = materialize(pairs.join(x, "src").join(y, "dst").select("src", "dst", "m", "n", "x", "y").mapInArrow(run, f"src {kind}, dst {kind}"), "pairs")
    discard(marks)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    """(node): what the pairs join, as a table; broadcast if it is small."""
    nodes = materialize(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), "nodes")
    return F.broadcast(nodes) if nodes.count() <= SMALL else nodes


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (src, dst) those whose texts' sets have a Jaccard similarity of at least P / Q, as a table. Only pairs that their sets'
    parities don't exclude have the sets beside them: a long text can be in many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            good = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(Q * both >= P * (len(x) + len(y) - both))
            yield b.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    nodes = _ends(pairs)
    sets = materialize(_sets(docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi")), "sets")
    pairs = _not_excluded(pairs, sets)
    few = sets.join(_ends(pairs), "node", "left_semi")
    x, y = few.select(F.col("node").alias("src"), F.col("hashes").alias("x")), few.select(F.col("node").alias("dst"), F.col("hashes").alias("y"))
    kind = pairs.schema["src"].dataType.simpleString()
    links = materialize(pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(run, f"src {kind}, dst {kind}"), "links")
    discard(sets, pairs)
    return links


def _differ(i: int) -> Column:
    return F.col("a.segments")[i].bitwiseXOR(F.col("b.segments")[i])


def _alike(far: int) -> Column:
    """Whether a row's texts a and b, by size and segments, can be similar and differ in at most `far` bits."""
    fits = F.least("a.size", "b.size") * Q >= F.greatest("a.size", "b.size") * P
    return fits & (sum((F.bit_count(_differ(i)) for i in range(WIDE)), F.lit(0)) <= far)


def _possible() -> Column:
    """Whether texts a and b that share a shingle, at place `at` in the order of each, can be similar. If it is their first one, they share none before it;
    and at least as many shingles are in one of them alone as parities differ."""
    both = F.col("a.size") + F.col("b.size")
    rest = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    differ = sum((F.bit_count(F.col("a.parities")[i].bitwiseXOR(F.col("b.parities")[i])) for i in range(BITS // 64)), F.lit(0))
    return (rest * (P + Q) >= both * P) & (differ * (P + Q) <= both * (Q - P))


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for the rows with an id: component_id is the least doc_id reachable over links of similar texts."""
    docs = texts(docs).where("doc_id is not null")
    sketches = materialize(_sketches(docs), "sketches")
    marks = sketches.where("slots is null")
    # texts with one set of shingles are one node, named by its least document
    one = marks.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "segments")).alias("of"), F.count("*").alias("n"))
    one = materialize(one.select("digest", F.col("of.doc_id").alias("node"), "of.size", "of.segments", "n"), "distinct")

    rows = one.select("node", F.posexplode("segments").alias("part", "segment"))
    rows = rows.select("node", "part", "segment", F.explode(F.sequence(F.lit(0), F.lit(WIDE_BITS - 1))).alias("bit"))
    key = F.expr(f"shiftleft(cast(part * {WIDE_BITS} + bit as bigint), {WIDE_BITS}) | (segment & ~shiftleft(1L, bit))").alias("key")
    of_key = Window.partitionBy("key")
    members = rows.select(key, "node").select("key", "node", F.min("node").over(of_key).alias("head"), F.count("*").over(of_key).alias("n"))
    members = materialize(members.where("n > 1"), "members")

    pairs = members.where("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst")).distinct()
    a, b = one.select(F.col("node").alias("src"), F.struct("size", "segments").alias("a")), one.select(F.col("node").alias("dst"), F.struct("size", "segments").alias("b"))
    first = materialize(pairs.join(a, "src").join(b, "dst").where(_alike(FAR)).select("src", "dst"), "pairs")
    links = _similar(first, docs)
    roots = components(links)

    discard(members, first, links)
    # what is left are links between texts of different roots: those that share one of their first shingles
    nodes = materialize(one.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(_firsts(docs, _crowds(sketches)), "node"), "nodes")
    rows = nodes.select("node", "root", F.posexplode("firsts").alias("at", "key"))
    of_key = Window.partitionBy("key")
    rows = rows.select("key", "node", "at", "root", F.count("*").over(of_key).alias("n"), F.min("root").over(of_key).alias("low"), F.max("root").over(of_key).alias("high"))
    shared = materialize(rows.where("low <> high").select("key", "node", "at", "root", "n"), "shared")
    rest = materialize(shared.join(nodes.select("node", "size", "parities"), "node"), "open")
    discard(shared, nodes)
    # a shingle with many members is shared out: each task has some of them against all
    share = F.ceil(F.col("n") / SHARE).cast("int")
    side = lambda name: F.struct("node", "root", "at", "size", "parities").alias(name)
    left = rest.select(F.col("key").alias("k"), F.pmod(F.hash("node"), share).alias("s"), side("a"))
    right = rest.select(F.col("key").alias("k2"), F.explode(F.sequence(F.lit(0), share - 1)).alias("s2"), side("b"))
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    more = left.join(right, (F.col("k") == F.col("k2")) & (F.col("s") == F.col("s2")) & apart & _possible())
    more = more.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct()
    more = materialize(more, "pairs")
    discard(rest)
    links = _similar(more, docs)
    # those links join components that are known: their graph is small
    of = lambda end, root: roots.select(F.col("node").alias(end), F.col("root").alias(root))
    ends = links.join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left")
    upper = components(ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = one.select("digest", "n", "node").join(roots, "node", "left").select("digest", "n", F.coalesce("root", "node").alias("root"))
    named = materialize(named.join(upper, "root", "left").select("digest", "n", F.coalesce("top", "root").alias("component_id")), "components")
    return join_hot(marks.select("doc_id", "digest"), named, "digest").select("doc_id", "component_id")


def similar_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its component of similar texts; all columns stay. Needs unique ids; rows of a null id stay."""
    lost = similar_groups(docs).where("doc_id <> component_id").select("doc_id")
    return keep_ids(docs, lost)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

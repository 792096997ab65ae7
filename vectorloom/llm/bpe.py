"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

The tokenizer comes from a tokenizer file, whose library encodes texts of ordinary length. A long text is halved down to
leaves that are encoded in parallel, as rows of their own. Neighbours are then concatenated, pair by pair, by encoding a
growing window around each join until it agrees with both sides exactly:

* A side agrees at a border between pre-tokens. The pre-tokenizer reads forward and keeps no state, so two readings of a
  text that share a border are equal from there on. Borders in the last bytes of a window don't count, for the next
  characters could move them.
* Inside a pre-token longer than the window, a side agrees on a whole token. BPE's result for a pre-token is the one
  sequence of its tokens in which each neighbouring pair is itself BPE's result, so sequences that share a token can be
  exchanged there.

Special tokens are found first, as the library does, and what lies between them is encoded apart.

Texts of ordinary length are mostly words that were met before. A blank before a character that is none always begins a
pre-token, so a text is cut there and a task remembers the library's tokens of the pieces.

Defined results: a null text is empty, and an empty text has no tokens; each of repeated rows gets the same result; an
empty table gives an empty result; other columns, whatever their names, are kept by `encode`. Texts of at most LONG
characters are encoded in one piece, longer ones, however long, by leaves of at most LEAF characters.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, join_hot, materialize, partitions, some, table

#: Characters of a leaf, and of the longest text that is encoded in one piece.
LEAF, LONG = 1 << 14, 1 << 15
#: Bytes at a window's end that don't settle a border, and the first window to each side of a join.
SLACK, WINDOW = 16, 128
#: Bytes to the nearest border beyond which a join is made inside a pre-token.
GIANT = 4096
#: Texts, or leaves, that are encoded at once: the library's encodings have some hundred bytes a token.
AT_ONCE = 32
#: Pieces whose tokens a task remembers, and characters of the longest of them.
PIECES, PIECE = 100_000, 48
#: Where a text is cut: some call U+180E blank, some don't. And what tells that it isn't cut at every space.
SPACE, CUT, ODD = re.compile(" "), re.compile(r" (?=[^\s\u180e])"), re.compile(r" (?:[\s\u180e]|\Z)")


class Codec:
    """A tokenizer with the tables that concatenation and decoding need."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        form = json.loads(spec)
        added = form["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        # printable stand-ins of the 256 bytes, in the order of byte-level BPE: bytes that print stand for themselves
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(of[c] for c in token)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        # pieces are independent only with byte-level BPE's own pre-tokenizer, as it is, and nothing before it
        before = form["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not (before["add_prefix_space"] or form["normalizer"] or form["post_processor"] or any(" " in s for s in self.special))
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """(text, special token after it) in turn."""
        out = [(text, None)]
        for content, i in self.special.items():
            out = [(part, i if k + 1 < len(parts) else after) for t, after in out for parts in [t.split(content)] for k, part in enumerate(parts)]
        return out

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Texts in one piece each."""
        return [ids for at in range(0, len(texts), AT_ONCE) for ids in self.few(texts[at : at + AT_ONCE])]

    def few(self, texts: list[str]) -> list[list[int]]:
        """A text's tokens are those of its first piece and those that are known, or learnt now, of the pieces after it."""
        cut = [(CUT if ODD.search(t) else SPACE).split(t) if self.cuts and not any(s in t for s in self.special) else [t] for t in texts]
        if len(self.known) > PIECES:
            self.known.clear()
        new = set(chain.from_iterable(islice(parts, 1, None) for parts in cut)).difference(self.known)
        self.learn(new)
        first = self.lib.encode_batch_fast([parts[0] for parts in cut], add_special_tokens=False) if texts else []
        out = [[*e.ids, *array("I", b"".join(map(self.known.__getitem__, islice(parts, 1, None))))] for e, parts in zip(first, cut, strict=True)]
        for p in new:
            if len(p) > PIECE:
                del self.known[p]
        return out

    def learn(self, new: Iterable[str]) -> None:
        """Encode pieces with a space before each, joined up to LONG characters and one piece more; where they end in bytes, a token ends."""
        some, size = [], 0
        for p in chain(new, [None]):
            if p is not None:
                some.append(p)
                size += len(p) + 1
            if some and (p is None or size >= LONG):
                (e,) = self.lib.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
                ids = np.array(e.ids, np.uint32)
                ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(x.encode()) + 1 for x in some])) + 1
                data, at = ids.tobytes(), 0
                for x, end in zip(some, (4 * ends).tolist(), strict=True):
                    self.known[x], at = data[at:end], end
                some, size = [], 0

    def leaf(self, text: str) -> Run:
        """A text without special tokens, with the borders of its pre-tokens."""
        e = self.lib.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        return Run(text.encode(), np.array(e.ids, np.int64), np.concatenate(([True], word[1:] != word[:-1]))[: len(word)])

    def decode(self, ids: list[int]) -> bytes:
        """The text of the tokens, as UTF-8; bytes that are no text become replacement characters."""
        joined = b"".join(map(self.bytes.__getitem__, ids))
        try:
            joined.decode()
            return joined
        except UnicodeDecodeError:
            return joined.decode("utf-8", "replace").encode()

    def concatenate(self, a: Run, b: Run) -> Run:
        """The encoding of both texts as one."""
        if not a.text or not b.text:
            return a if not b.text else b
        starts_a, starts_b = a.starts(self.length), b.starts(self.length)
        borders_a, borders_b = np.append(starts_a[a.first], 0), starts_b[b.first]
        n, grow = len(a.text), WINDOW
        while True:
            # to the left: a border that the cut cannot have moved, or a token inside a long pre-token
            cut = int(borders_a[borders_a <= max(0, n - max(grow, SLACK))].max())
            at, inside = int(np.searchsorted(starts_a, cut)), False
            if n - cut > GIANT + grow:
                near = np.nonzero((starts_a > cut) & (starts_a <= n - grow))[0]
                near = [i for i in near[::-1][:8] if a.text[starts_a[i]] & 0xC0 != 0x80]
                last = borders_a[borders_a <= n - SLACK].max()
                if near and starts_a[near[0]] > last:
                    at, cut, inside = int(near[0]), int(starts_a[near[0]]), True
            # to the right: so many bytes, up to the end of a token
            j = int(np.searchsorted(starts_b, grow))
            while j < len(starts_b) and b.text[starts_b[j]] & 0xC0 == 0x80:
                j += 1
            end = int(starts_b[j]) if j < len(starts_b) else len(b.text)
            c = self.leaf((a.text[cut:] + b.text[:end]).decode())
            starts_c = c.starts(self.length)
            agrees = not inside or (len(c.ids) > 1 and c.ids[0] == a.ids[at])
            if agrees and end == len(b.text):
                return a.spliced(at, c, len(c.ids), b, len(b.ids), inside)
            if agrees:
                borders_c = starts_c[c.first] + cut - n
                shared = np.intersect1d(borders_c[(borders_c >= 0) & (borders_c <= end - SLACK)], borders_b)
                if len(shared):
                    k = int(shared[0])
                    return a.spliced(at, c, int(np.searchsorted(starts_c, k + n - cut)), b, int(np.searchsorted(starts_b, k)), inside)
                long_b = not (borders_b[1:] <= end + SLACK).any()
                if long_b and borders_c[-1] < 0 and len(c.ids) > 1 and c.ids[-1] == b.ids[j - 1]:
                    return a.spliced(at, c, len(c.ids), b, j, inside)
            grow *= 2

    def tree(self, runs: list[Run]) -> Run:
        """Concatenate neighbours until one run is left."""
        while len(runs) > 1:
            runs = [self.concatenate(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0]

    def encode(self, text: str) -> list[int]:
        """Any text in one process; `encode` of the module deals the leaves of long texts to tasks."""
        if len(text) <= LONG:
            return self.batch([text])[0]
        out: list[int] = []
        for piece, special in self.pieces(text):
            if piece:
                out += self.tree([self.leaf(x) for x in leaves(piece)]).ids.tolist()
            if special is not None:
                out.append(special)
        return out


class Run:
    """A text, its tokens, and which of them begin a pre-token."""

    def __init__(self, text: bytes, ids: np.ndarray, first: np.ndarray):
        self.text, self.ids, self.first = text, ids, first

    def starts(self, length: np.ndarray) -> np.ndarray:
        n = length[self.ids]
        return np.cumsum(n) - n

    def spliced(self, at: int, c: Run, c_end: int, b: Run, b_at: int, inside: bool) -> Run:
        first = c.first[:c_end].copy()
        if inside and len(first):
            first[0] = self.first[at]
        return Run(self.text + b.text, np.concatenate((self.ids[:at], c.ids[:c_end], b.ids[b_at:])), np.concatenate((self.first[:at], first, b.first[b_at:])))


def leaves(text: str) -> list[str]:
    """Halves of halves, until none is longer than a leaf."""
    if len(text) <= LEAF:
        return [text]
    half = len(text) // 2
    return leaves(text[:half]) + leaves(text[half:])


@lru_cache(maxsize=2)
def _codec(spec: str) -> Codec:
    codec = Codec(spec)
    give_back()  # the file's parsed form
    return codec


def _digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    words = array("I", ids)  # four bytes each, on the platforms that Spark runs on
    if sys.byteorder == "big":
        words.byteswap()
    return len(ids), hashlib.sha256(words).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids to the rows of `docs`, in place of columns of these names.

    Short texts are encoded where they are read. The distinct long ones are cut into leaves, which are dealt out,
    encoded, and concatenated by text; their rows then join the result by the text's digest.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # the driver's copy goes to the tasks; a tokenizer file has a fixed size
        spec = spark.sparkContext.broadcast(f.read())
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if ids else {})
    ddl = ", ".join(f"{k} {({pa.int64(): 'long', pa.string(): 'string'}).get(v, 'array<int>')}" for k, v in kinds.items())

    def result(codec: Codec, encoded: list[list[int]]) -> list[pa.Array]:
        columns = list(zip(*(_digests(codec, x) for x in encoded), strict=True)) or [[], [], []]
        return [pa.array(c, k) for c, k in zip([*columns, *([encoded] if ids else [])], kinds.values(), strict=True)]

    names = [c for c in docs.columns if c not in kinds]
    others = [F.col(f"`{c}`") for c in names if c != "text"] or [F.lit(None).cast("int").alias("none")]
    packed = docs.select(F.struct(*others).alias("row"), "text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in some(batches, AT_ONCE):
            texts = ["" if t is None else t for t in b["text"].to_pylist()]
            once = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # a mix repeats its rows side by side
            at = pa.array([once[t] for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *(c.take(at) for c in result(codec, codec.batch(list(once))))], [*b.schema.names, *kinds])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in some(batches):
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                rows = []
                for p, (piece, special) in enumerate(codec.pieces(text)):
                    rows += [(p, i, x, None) for i, x in enumerate(leaves(piece))]
                    rows += [(p, len(rows), "", special)] if special is not None else []
                for at in range(0, len(rows), 64):
                    columns = list(zip(*rows[at : at + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(columns[0])), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["key", "piece", "leaf", "text", "special"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in some(batches, AT_ONCE):
            runs = [codec.leaf(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.ids.astype("<u4").tobytes() for r in runs], pa.binary()), pa.array([r.first.tobytes() for r in runs], pa.binary())], [*b.schema.names, "run", "first"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, done, runs, piece = _codec(spec.value), None, [], [], None

        def close_piece():
            nonlocal runs
            if runs:
                done.extend(codec.tree(runs).ids.tolist())
            runs = []

        def close():
            close_piece()
            return pa.RecordBatch.from_arrays([pa.array([now]), *result(codec, [done])], ["key", *kinds])

        for b in some(batches, AT_ONCE):
            for key, p, text, special, run, first in zip(*(b[k].to_pylist() for k in ("key", "piece", "text", "special", "run", "first")), strict=True):
                if key != now:
                    if now is not None:
                        yield close()
                    now, done, piece = key, [], p
                if p != piece:
                    close_piece()
                    piece = p
                if special is not None:
                    close_piece()
                    done.append(special)
                elif text:
                    runs.append(Run(text.encode(), np.frombuffer(run, "<u4").astype(np.int64), np.frombuffer(first, bool)))
        if now is not None:
            yield close()

    size = F.length(F.coalesce("text", F.lit("")))
    near = packed.where(size <= LONG).mapInArrow(short, T.StructType([*packed.schema.fields, *T._parse_datatype_string(ddl).fields]))
    key = F.sha2("text", 256).alias("key")
    n = partitions(spark)
    segments = packed.where(size > LONG).select(key, "text").dropDuplicates(["key"]).mapInArrow(cut, "key string, piece long, leaf long, text string, special long")
    runs = segments.repartition(n, "key", "piece", "leaf").mapInArrow(encoded, "key string, piece long, leaf long, text string, special long, run binary, first binary")
    whole = runs.repartition(n, "key").sortWithinPartitions("key", "piece", "leaf").mapInArrow(joined, f"key string, {ddl}")
    times = packed.where(size > LONG).groupBy(key).agg(F.count("*").alias("n"))
    whole = materialize(whole.join(times, "key"), "long-texts")
    far = join_hot(packed.where(size > LONG).withColumn("key", key), whole, "key").drop("key", "n")
    return near.unionByName(far).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names], *kinds)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, default_path(), ids=False).drop("text")

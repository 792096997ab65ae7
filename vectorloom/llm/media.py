"""Media columns: Netpbm and BMP pictures as numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

Everything is per row in bounded blocks of samples; Spark partitions the work and nothing is shuffled. Texts become
pictures in a table of their own, a media column in the shared folder, and features are computed from what is read back.

Defined results: null media or text is empty; an empty text has a payload of 64 zero bytes; bytes that no decoder knows,
or whose header and size disagree, give null features in `media_features`; pictures without samples are refused like
unknown ones; ties of neighbouring samples are zero bits of the hash; equal and repeated rows get equal values; very
long texts are stored whole; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, some, table, texts, utf8

WIDTH, SIDE = 64, 16
#: Samples that are summed at once, at least a row of the picture; and the digits that a number in a header can have.
BLOCK, DIGITS = 1 << 18, 9


# ---- Netpbm -------------------------------------------------------------------------------------------------------


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey map (P5) of 8-bit samples, shape (rows, columns)."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8, copy=False).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """A binary pixel map (P6) of 8-bit samples, shape (rows, columns, 3)."""
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8, copy=False).tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers, and where the samples start; comments run from # to the end of a line."""
    numbers, at = [], 2
    while len(numbers) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) if data[at : at + 1] == b"#" else at) + 1 or len(data)
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if not 0 < end - at <= DIGITS:
            raise ValueError("a number is missing in the header, or too long")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array: (rows, columns) or (rows, columns, 3); 16 bits a sample where the largest value is over 255. Bit maps have 0 for black, 1 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm picture")
    bits = kind in (b"P1", b"P4")
    numbers, at = _header(data, 2 if bits else 3)
    w, h = numbers[:2]
    most = 1 if bits else numbers[2]
    if w < 1 or h < 1 or not 0 < most < 65536:
        raise ValueError("impossible size")
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = math.prod(shape)
    if n > 8 * len(data):
        raise ValueError("fewer bytes than samples")
    if kind == b"P4":
        stride = (w + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)
        return 1 - np.unpackbits(rows, axis=1)[:, :w]
    if kind == b"P1":
        found = np.frombuffer(data[at - 1 :], np.uint8)
        found = found[(found == 48) | (found == 49)][:n] - 48
        return 1 - found.reshape(shape)
    if kind in (b"P2", b"P3"):
        found = np.array(data[at - 1 :].split(None, n)[:n], dtype="S9").astype(np.int64)  # longer ones are cut, and too large still
        if (found > most).any():
            raise ValueError("a sample is above the largest value")
    else:
        found = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at)
    return found.reshape(shape).astype(np.uint8 if most < 256 else np.uint16)


# ---- BMP ----------------------------------------------------------------------------------------------------------


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey with a palette, or 24-bit colour; rows from the bottom, each padded to four bytes."""
    h, w = samples.shape[:2]
    deep = samples.ndim == 3
    palette = b"" if deep else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).tobytes()
    rows = samples[::-1, :, ::-1].reshape(h, w * 3) if deep else samples[::-1]
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if deep else 8, 0, rows.size, 2835, 2835, 0 if deep else 256, 0)
    return head + info + palette + rows.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (by its palette) and 24- or 32-bit pictures; grey palettes give (rows, columns), others (rows, columns, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP picture")
    start, size, w, h = struct.unpack("<IIii", data[10:26])
    depth, packed = struct.unpack("<HI", data[28:34])
    if packed or depth not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("this kind of BMP is not read")
    up, h = h > 0, abs(h)
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * depth // 8]
    rows = rows[::-1] if up else rows
    if depth > 8:
        return rows.reshape(h, w, depth // 8)[:, :, 2::-1].copy()
    used = struct.unpack("<I", data[46:50])[0] or 256
    palette = np.zeros((256, 3), np.uint8)
    palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = (palette[:, :1] == palette).all()
    return palette[rows, 0] if grey else palette[rows]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---- features -----------------------------------------------------------------------------------------------------


def area_resize(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of the area under each new sample. The integral image is only kept at the new columns' borders, and summed a
    block of rows at a time; borders between samples are interpolated, which is exact for integrals of constant samples."""
    grey = samples if samples.ndim == 2 else None
    if grey is None:
        return np.stack([area_resize(samples[:, :, c], rows, columns) for c in range(samples.shape[2])], axis=2)
    h, w = samples.shape
    ys, xs = np.arange(rows + 1) * h / rows, np.arange(columns + 1) * w / columns
    x0 = np.minimum(xs.astype(int), w - 1)
    out, carry = np.zeros((rows + 1, columns + 1)), np.zeros(columns + 1)
    y0 = np.minimum(ys.astype(int), h - 1)
    step = max(1, BLOCK // w)
    for at in range(0, h, step):
        part = samples[at : at + step]
        across = np.zeros((len(part), w + 1))
        np.cumsum(part, axis=1, dtype=np.float64, out=across[:, 1:])
        lines = across[:, x0] + (across[:, x0 + 1] - across[:, x0]) * (xs - x0)
        down = np.vstack([carry, carry + np.cumsum(lines, axis=0)])
        for i in np.nonzero((y0 >= at) & (y0 < at + len(part)))[0]:
            k = y0[i] - at
            out[i] = down[k] + (down[k + 1] - down[k]) * (ys[i] - y0[i])
        carry = down[-1]
    return np.diff(np.diff(out, axis=0), axis=1) / ((h / rows) * (w / columns))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits, as hex: each sample of an 8 by 8 grid against its right neighbour on a 9 wide one."""
    small = area_resize(samples if samples.ndim == 2 else samples.mean(axis=2), 8, 9)
    return np.packbits(np.round(small[:, :-1], 6) < np.round(small[:, 1:], 6)).tobytes().hex()


def tile(samples: np.ndarray, side: int = SIDE) -> bytes:
    """The NPY bytes of the picture, area-resized to side by side 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_features(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", side: int = SIDE) -> DataFrame:
    """(id, height, width, channels, tile, dhash) of Netpbm or BMP bytes; null features where they can't be decoded."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            out = []
            for data in b[media_col].to_pylist():
                try:
                    x = decode(data or b"")
                    out.append((x.shape[0], x.shape[1], x.shape[2] if x.ndim == 3 else 1, tile(x, side), difference_hash(x)))
                except (ValueError, OverflowError, struct.error):
                    out.append((None,) * 5)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b[id_col], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], [id_col, "height", "width", "channels", "tile", "dhash"])

    return rows.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, height long, width long, channels long, tile binary, dhash string")


def pack(data: bytes, width: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of `width`."""
    return data + bytes(-len(data) % width or (0 if data else width))


def stored_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, format, media): each text as a picture `width` samples wide, a grey map or a grey BMP by the parity of its bytes' crc32."""

    def one(data: bytes) -> tuple:
        samples = np.frombuffer(pack(data, width), np.uint8).reshape(-1, width)
        odd = zlib.crc32(data) & 1
        return len(data), "bmp" if odd else "pgm", (encode_bmp if odd else encode_pgm)(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            n, kind, media = zip(*map(one, utf8(b["text"])), strict=True)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(kind), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "format", "media"])

    docs = texts(docs)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, format string, media binary")


def text_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Store each text losslessly as a picture in a table, read that back, and give its digests, features and tile."""

    def one(media: bytes) -> tuple:
        x = decode(media)
        back, npy, shown = x.tobytes(), tile(x), difference_hash(x)
        feature = f"{shown}:{hashlib.sha256(npy).hexdigest()[:16]}:{x.shape[0]}x{x.shape[1]}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-width:]), feature, npy, shown

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "tile", "dhash"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            columns = zip(*map(one, b["media"].to_pylist()), strict=True)
            same = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "format"]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in same), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*same, *names])

    stored = materialize(stored_texts(docs, width), "media")
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    ddl = ", ".join(f"{n} {({pa.string(): 'string', pa.binary(): 'binary'}).get(k, 'long')}" for n, k in zip(names, kinds, strict=True))
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, format string, {ddl}")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))

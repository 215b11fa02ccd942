"""PNG columns: bytes as 8-bit grey samples through zlib chunks with checksums, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, make_room, schema_of, small_batches, utf8

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of ``payload``, rows of ``width`` samples; a private chunk keeps how many bytes are not padding.

    One filter of none, left and up serves the image: the one with the least sum of absolute differences.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    kind, best = min(enumerate((rows, left, up)), key=lambda x: int(np.abs(x[1].view(np.int8).astype(np.int16)).sum()))
    lines = np.concatenate([np.full((len(rows), 1), kind, np.uint8), best], axis=1)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"byTe", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> dict[bytes, bytes]:
    """Chunk bodies by kind, IDAT chunks joined. A wrong signature, length or checksum raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, out = 8, {}
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} fails its checksum")
        out[kind] = out.get(kind, b"") + body
        at += 12 + n
    if b"IEND" not in out or b"IHDR" not in out:
        raise ValueError("a chunk is missing")
    return out


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters (one byte per sample): rows of filter type and samples in, samples out.

    Runs of rows of one type go at once where rows (left) or columns (up) are running sums; average and Paeth go sample by sample.
    """
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    bounds = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kinds[a] == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kinds[a] == 2:
            out[a:b] = np.cumsum(np.vstack([above, out[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kinds[a] > 2:
            for r in range(a, b):
                row, left, corner = out[r], 0, 0
                for c in range(len(row)):
                    up = int(above[c])
                    if kinds[a] == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                    left, corner = (int(row[c]) + guess) & 255, up
                    row[c] = left
                above = row
    return out


def decode_png(png: bytes) -> tuple[np.ndarray, int | None]:
    """Samples of a grey 8-bit PNG, rows by width, and the number of bytes that it says it holds, if it does."""
    parts = chunks(png)
    width, height, depth, colour, *_, lace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if (depth, colour, lace) != (8, 0, 0):
        raise ValueError("only 8-bit grey without interlace is read")
    raw = zlib.decompress(parts[b"IDAT"])
    if len(raw) != height * (width + 1):
        raise ValueError("the image has too few samples")
    n = parts.get(b"byTe")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1)), struct.unpack(">Q", n)[0] if n else None


def _cosines(n: int = SIDE, low: int = LOW) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(low), np.arange(n) + 0.5))


COSINES = _cosines()


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which of the 8 by 8 lowest cosine frequencies of the image, shrunk to 32 by 32 by means, exceed their median."""
    image = samples.astype(np.float64)
    for axis in (0, 1):
        n = image.shape[axis]
        if n < SIDE:
            image = np.take(image, np.arange(SIDE) * n // SIDE, axis=axis)
        elif n > SIDE:
            cuts = np.arange(SIDE) * n // SIDE
            image = np.add.reduceat(image, cuts, axis=axis) / np.expand_dims(np.diff(np.r_[cuts, n]), 1 - axis)
    low = np.round(COSINES @ image @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_png(df: DataFrame, content: str = "content", out: str = "media") -> DataFrame:
    """Append a PNG of the binary column ``content``, padded with zero bytes to a positive multiple of 64; null counts as empty.

    A column of the input that is called ``out`` gets ``input_`` before its name. Rows keep to themselves: repeated contents give
    equal PNGs, an empty table no rows. A PNG has up to 2^31 - 1 rows of 64 bytes, more than a value can hold.
    """
    df, names = make_room(df, [out])
    content = names[content]

    def run(batches):
        for batch in batches:
            made = []
            for x in batch[content].to_pylist():
                x = x or b""
                made.append(encode_png(x + bytes(-len(x) % WIDTH or (0 if x else WIDTH)), len(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, out])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema_of(df).add(out, "binary"))


def png_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Append what the stored PNGs hold: ``n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    All null for a null PNG; one that fails its checksums raises ValueError. Columns of the input with these names get ``input_``
    before theirs.
    """
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    df, names = make_room(df, kinds)
    media = names[media]
    schema = schema_of(df)
    for c, kind in kinds.items():
        schema = schema.add(c, "long" if kind == pa.int64() else "string")

    def features(png: bytes | None) -> tuple:
        if png is None:
            return (None,) * len(kinds)
        samples, n = decode_png(png)
        payload = samples.tobytes()
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)

    def run(batches):
        for batch in batches:
            made = [features(x) for x in batch[media].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in made], k) for i, k in enumerate(kinds.values()))], [*batch.schema.names, *kinds])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def op3_media_png(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a PNG in a binary column, read back, with digests and a cosine hash."""
    stored = to_png(documents(spark, sf_dir).select("doc_id", utf8(F.col("text")).alias("content"))).drop("content")
    return png_features(stored).drop("media")

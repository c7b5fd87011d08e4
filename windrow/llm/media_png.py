"""Media columns: lossless 8-bit grey PNG files in binary columns, and cosine-transform hashes of what they hold.

encode() turns binary payloads into PNG files, decode() parses stored files (chunk by chunk, with checksum tests) and
returns samples and features. Both work batch by batch on Arrow columns, so a row never leaves its partition.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import packed, table, unpacked

#: Fixed values of the PNG format: signature; bytes of length, type and checksum in a chunk; filter types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH = 64
LEVEL = 4
#: Rows that are filtered at once.
SLICE_ROWS = 1 << 14
#: Compressed bytes of one IDAT chunk.
IDAT_BYTES = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _choose_filters(rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter type per row, and the filtered rows: the candidate with the smallest sum of magnitudes as signed bytes.

    `before` is the row above the first.
    """
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.concatenate([before[None], rows[:-1]])
    forms = np.stack([rows, rows - left, rows - above])  # uint8: wraps modulo 256, as the format asks
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    return best.astype(np.uint8), forms[best, np.arange(len(rows))]


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG, 8 bits a sample, `width` samples a row; the payload's length is a positive multiple of width.

    Rows are filtered and compressed in slices, so a long payload takes little more than itself.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    squeeze, packed, before = zlib.compressobj(LEVEL), [], np.zeros(width, np.uint8)
    for i in range(0, len(rows), SLICE_ROWS):
        part = rows[i : i + SLICE_ROWS]
        kinds, body = _choose_filters(part, before)
        packed.append(squeeze.compress(np.concatenate([kinds[:, None], body], axis=1).tobytes()))
        before = part[-1]
    whole = b"".join([*packed, squeeze.flush()])
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", whole[i : i + IDAT_BYTES]) for i in range(0, len(whole), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _undo_run(kind: int, run: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undoes one filter over neighbouring rows of the same type; `above` is the row before them."""
    if kind == NONE:
        return run
    if kind == SUB:
        h, w = run.shape
        return np.cumsum(run.reshape(h, w // step, step), axis=1, dtype=np.uint8).reshape(h, w)
    if kind == UP:
        out = np.cumsum(run, axis=0, dtype=np.uint8)
        return out + above
    out = np.empty_like(run)
    for y in range(len(run)):
        line, up = run[y].astype(np.int32).tolist(), above.astype(np.int32).tolist()
        for x in range(len(line)):
            a = line[x - step] if x >= step else 0
            b = up[x]
            if kind == AVERAGE:
                guess = (a + b) // 2
            else:
                c = up[x - step] if x >= step else 0
                near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                guess = (a, b, c)[near.index(min(near))]
            line[x] = (line[x] + guess) & 255
        above = out[y] = np.array(line, np.uint8)
    return out


def read_png(stored: bytes) -> np.ndarray:
    """Samples of a non-interlaced 8-bit grey, grey+alpha, RGB or RGBA PNG, as height x (width * channels).

    Raises ValueError where the signature, a chunk's checksum, the zlib stream's checksum or a size is wrong.
    """
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if at + 12 + n > len(stored) or struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            if len(body) != 13:
                raise ValueError("a header of a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2, 4, 6) or any(head[4:]):
        raise ValueError("not a whole 8-bit non-interlaced PNG without palette")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    width, height = head[0] * step, head[1]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"zlib stream: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("the samples do not fill the image")
    raw = raw.reshape(height, width + 1)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown filter type")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    above = np.zeros(width, np.uint8)
    for a, b in zip([0, *edges], [*edges, height], strict=True):
        if b > a:
            out[a:b] = _undo_run(int(kinds[a]), out[a:b], above, step)
            above = out[b - 1]
    return out


def _cosines(side: int, low: int) -> np.ndarray:
    k, n = np.arange(low)[:, None], np.arange(side)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * side))


SIDE, LOW = 32, 8
COSINES = _cosines(SIDE, LOW)


def cosine_hash(samples: np.ndarray) -> str:
    """64-bit hash of the 8 x 8 lowest frequencies of the image shrunk to 32 x 32 by area means, as 16 hex digits.

    A bit is 1 where the coefficient is above the median of all 64; row-major, highest bit first.
    """
    grid = samples
    for axis in (0, 1):
        n = grid.shape[axis]
        if n < SIDE:
            grid = np.take(grid, np.arange(SIDE) * n // SIDE, axis=axis)
        elif n > SIDE:
            cuts = np.arange(SIDE) * n // SIDE
            sizes = np.diff([*cuts, n])
            grid = np.add.reduceat(grid, cuts, axis=axis, dtype=np.float64) / (sizes[:, None] if axis == 0 else sizes[None, :])
    low = np.round(COSINES @ grid @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit if raw else unit)


READ = T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("feature", "string")


@F.pandas_udf(T.BinaryType())
def encode(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """PNG file of each binary value, padded with zero bytes to whole rows; null counts as empty."""
    for batch in payloads:
        yield pd.Series([write_png(pad(bytes(x) if x is not None else b"")) for x in batch], dtype=object)


@F.pandas_udf(READ)
def decode(stored: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What the stored files hold: length, digest and tail checksum of the samples, and their cosine hash."""
    for batch in stored:
        out = []
        for x in batch:
            samples = read_png(bytes(x))
            data = samples.tobytes()
            out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), cosine_hash(samples)))
        yield pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def with_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with a binary column of PNG files that hold the UTF-8 bytes of text_col.

    Null and empty texts give a row of zero bytes; equal texts give equal files; other columns stay, but one of the name
    media_col is replaced; an empty table gives an empty one.
    """
    return df.withColumn(media_col, encode(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload_bytes, payload_sha256, tail_crc32 and feature, read back from the stored files.

    Rows stay as many as they are; an empty table gives an empty one; columns of df that bear one of the names are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in READ.names]
    return df.select(packed(df, kept), decode(F.col(media_col)).alias("got")).select(*unpacked(kept), "got.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = with_media(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    return media_features(sized).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )

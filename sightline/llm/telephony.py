"""Media columns: telephony audio.

A payload is stored as the 8-bit samples of a mu-law WAVE file (one byte a
sample, so any bytes are stored without loss) and read back by walking the
file's chunks. Its samples are then decoded three ways: mu-law and A-law by
tables of 256 entries, and as IMA ADPCM in blocks of 64 bytes, one numpy step
for each of the 120 samples over all blocks of an Arrow batch. Mu-law PCM is
resampled from 8 to 16 kHz.

Nothing is shuffled; a batch is worked on in parts of about ``PART`` bytes, and
a text beyond that by itself.

Cases. Null or empty text: a payload of 64 zero bytes, ``n_bytes`` 0. Null ids
are passed on, repeated rows each give a row; equal texts give equal values. A
very long text is a part by itself. Empty tables give empty results. Only the two
named columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table

RATE, BLOCK, PART = 8000, 64, 4 << 20
MULAW = 7

# Fixed values of the IMA ADPCM format: quantiser steps and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """Linear values of the 256 mu-law codes (G.711)."""
    u = ~np.arange(256) & 255
    t = (((u & 15) << 3) + 132) << ((u >> 4) & 7)
    return np.where(u & 128, 132 - t, t - 132).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear values of the 256 A-law codes (G.711)."""
    a = np.arange(256) ^ 0x55
    seg, t = (a >> 4) & 7, ((a & 15) << 4) + 8
    t = np.where(seg > 0, (t + 256) << np.maximum(seg - 1, 0), t)
    return np.where(a & 128, t, -t).astype(np.int16)


_ULAW, _ALAW = mulaw_table(), alaw_table()
#: change of the predictor for (index, nibble), and the next index
_N = np.arange(16)
_DIFF = ((STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_N & 1) + (STEPS[:, None] >> 1) * (_N >> 1 & 1) + STEPS[:, None] * (_N >> 2 & 1)) * np.where(_N & 8, -1, 1)
_DIFF = _DIFF.astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_N & 7], 0, 88) * 16).astype(np.int32).ravel()


def write_wave(samples: bytes, tag: int = MULAW, rate: int = RATE) -> bytes:
    """A WAVE file of 8-bit samples of one channel."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(data: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and samples of a WAVE file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate, samples = 12, None, 0, None
    while at + 8 <= len(data):
        name, n = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
        elif name == b"data":
            samples = data[at + 8:at + 8 + n]
        at += 8 + n + n % 2
    if tag is None or samples is None:
        raise ValueError("a chunk is missing")
    return tag, rate, samples


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows of bytes): a header of 4 bytes, then two samples a byte."""
    b = np.ascontiguousarray(blocks)
    value = b[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(b[:, 2], 88).astype(np.int32) * 16
    data = np.ascontiguousarray(b[:, 4:].T)
    out = np.empty((1 + 2 * data.shape[0], len(b)), np.int16)
    out[0] = value
    for i, byte in enumerate(data):
        for j, nibble in enumerate((byte & 15, byte >> 4)):
            at = index + nibble
            value = np.clip(value + _DIFF[at], -32768, 32767)
            index = _NEXT[at]
            out[1 + 2 * i + j] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate, by linear interpolation; the last sample is held."""
    x = pcm.astype(np.int32)
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    out[1::2] = (x + np.append(x[1:], x[-1:])) >> 1
    return out


def payload(text: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of 64."""
    return text + b"\0" * (BLOCK - len(text) % BLOCK if len(text) % BLOCK or not text else 0)


def _stats(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    return f"{int((x * x).sum()) // len(x)}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}:{int(np.abs(x).max())}"


def _describe(samples: bytes, dec: np.ndarray) -> str:
    codes = np.frombuffer(samples, np.uint8)
    u = _ULAW[codes]
    return f"ulaw={_stats(u)};alaw={_stats(_ALAW[codes])};adpcm={zlib.crc32(dec.tobytes()):08x};pcm16k={zlib.crc32(resample(u).tobytes()):08x}"


def _parts(texts: list[bytes]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART:
            yield texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = True) -> DataFrame:
    """``id``, the digests of payload and stored form, the feature, and if ``media`` the stored bytes and the resampled PCM."""
    ship(docs.sparkSession)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "pcm16k"] * media
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * 2 * media

    def run(batches):
        for b in batches:
            rows = []
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1)]
            for part in _parts(texts):
                stored = [write_wave(payload(t)) for t in part]
                back = [read_wave(m)[2] for m in stored]
                ends = np.cumsum([len(s) // BLOCK for s in back])
                dec = adpcm(np.frombuffer(b"".join(back), np.uint8).reshape(-1, BLOCK))
                for t, m, s, e in zip(part, stored, back, ends, strict=True):
                    row = [len(t), len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), _describe(s, dec[e - len(s) // BLOCK:e])]
                    rows.append(row + [m, resample(_ULAW[np.frombuffer(s, np.uint8)]).tobytes()] * media if media else row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, pcm16k binary" * media
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every whole text of ``documents`` stored, read back and described."""
    return store(table(spark, sf_dir, "documents"), media=False).withColumnRenamed("id", "doc_id")

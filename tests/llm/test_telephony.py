import hashlib
import zlib

import numpy as np
import pytest

from sightline.llm import telephony as t


def adpcm_plain(block):
    """One block, sample by sample."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            d = step >> 3
            if n & 4:
                d += step
            if n & 2:
                d += step >> 1
            if n & 1:
                d += step >> 2
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
            out.append(value)
    return out


def test_decoders():
    g = np.random.default_rng(1)
    b = g.integers(0, 256, (50, 64)).astype(np.uint8)
    assert t.adpcm(b).tolist() == [adpcm_plain(bytes(x)) for x in b]
    # ends and zeros of G.711
    assert [int(t._ULAW[i]) for i in (0x00, 0x7F, 0x80, 0xFF, 0xF0)] == [-32124, 0, 32124, 0, 120]
    assert [int(t._ALAW[i]) for i in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert t.resample(np.array([0, 10, -4], np.int16)).tolist() == [0, 5, 10, 3, -4, -4]


def test_wave_round_trip():
    for n in (64, 65, 128):
        p = bytes(range(n))
        assert t.read_wave(t.write_wave(p)) == (7, 8000, p)
    with pytest.raises(ValueError):
        t.read_wave(b"nonsense")


def test_rows(spark, monkeypatch):
    texts = [None, "", "abc", "é" * 32, "x" * 200, "x" * 200, "long " * 3000]
    d = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, feature int")
    rows = {r.id: r for r in t.store(d).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes and len(r.pcm16k) == 4 * len(p)
        assert t.read_wave(bytes(r.media))[2] == p
        dec = b"".join(np.array(adpcm_plain(p[k:k + 64]), np.int16).tobytes() for k in range(0, len(p), 64))
        assert f"adpcm={zlib.crc32(dec):08x}" in r.feature
    assert rows[0].feature == rows[1].feature and rows[4].feature == rows[5].feature
    assert t.store(d.limit(0), media=False).collect() == []


def test_rows_without_id_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "abc"), (None, "abc"), (None, None), (7, "abc")], "doc_id long, text string")
    rows = t.store(d, media=False).collect()
    assert sorted(str(r.id) for r in rows) == ["7", "None", "None", "None"]
    assert len({tuple(r)[1:] for r in rows}) == 2

"""Vectorised hashes of words and word sequences, equal in every Python worker."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Bytes hashed at once; bounds the memory of a long text.
CHUNK = 4 << 20
#: Longer words (in bytes) are hashed one by one.
LONG = 256
SPACE = b" \t\n\r\x0b\x0c"


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = mix(np.arange(1000, 1256, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
#: The lowest n bytes of a 64-bit value.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True


def _chunks(data: bytes):
    """Parts of the text that end at white space, about CHUNK bytes each."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of the bytes, in order.

    Eight bytes at a time are added to a state that is scrambled in between, so
    words of up to eight bytes never collide with each other, and the structure
    of longer words does not make them collide. Lanes are independent hashes.
    """
    out = []
    for part in _chunks(data):
        b = np.frombuffer(part + bytes(8), np.uint8)
        gap = _GAP[b[:-8]]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            continue
        lens = ends - starts
        eight = np.ndarray(len(b) - 7, "<u8", b, strides=(1,))  # eight bytes from every place
        h = lens.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03) * _U(lane)
        at = np.arange(len(starts))
        for k in range(0, LONG, 8):
            if k:
                at = at[lens[at] > k]
                if not len(at):
                    break
            h[at] = mix(h[at] ^ (eight[starts[at] + k] & _LOW[np.minimum(lens[at] - k, 8)]))
        for i in np.flatnonzero(lens > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(part[starts[i]:ends[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, _U)


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes; entry i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    h = np.zeros(n, _U)
    for j in range(k):
        h += words[j:j + n] * _STEP[j % 256] + _U(j)
    return mix(h)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences, which compress well."""
    d = np.diff(values, prepend=_U(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """Inverse of :func:`pack_sorted`."""
    d = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(d.view("<u8").ravel(), dtype=_U)

"""Vectorised words of many texts: positions and 64-bit hashes by numpy."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 20
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            back = np.uint64(pow(int(_P), -1, 1 << 64))
            up, down = np.full(size, _P), np.full(size, back)
            up[0] = down[0] = 1
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space in a byte array."""
    word = np.ones(256, dtype=bool)
    word[[32, 9, 10, 11, 12, 13]] = False
    inside = np.concatenate([[False], word[buf], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span: a polynomial in the bytes, finished by ``mix``."""
    up, down = _inverse_powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def batches(texts: list, chars: int = _CHUNK):
    """Consecutive index ranges of at most ``chars`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(texts):
        yield lo, len(texts)


def words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts (A-Z lower-cased, joined by line breaks), word starts, word
    ends and the text that each word belongs to. None counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    starts, ends = spans(buf)
    return buf, starts, ends, np.searchsorted(at, starts, side="right") - 1

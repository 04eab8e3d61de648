"""Words and their hashes for a whole Arrow batch at once, in numpy, with no step per word in Python."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
M1, M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
CHUNK_BYTES = 1 << 20


def byte_set(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Bytes of words where words are runs of anything but ASCII white space.
NOT_SPACE = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words where words are runs of 0-9, a-z and everything beyond ASCII.
ALNUM = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * M1
    h ^= h >> U(29)
    h *= M2
    h ^= h >> U(32)
    return h


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in bytes); a null is an empty text. A text over `most` bytes is a chunk of its own."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, which never cross a row, and for each row the number of words before it (one more entry at the end)."""
    n = len(buf)
    w = member[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes from which a word is hashed by itself.
LONG_WORD = 1 << 16


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap. Memory beyond the result is bounded, however long the text is."""
    out = np.empty(len(starts), dtype=U)
    size = ends - starts
    for k in np.flatnonzero(size >= LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.md5(buf[starts[k] : ends[k]].tobytes()).digest()[:8], "little")
    short = np.flatnonzero(size < LONG_WORD)
    at = 0
    while at < len(short):
        first = int(starts[short[at]])
        until = int(np.searchsorted(starts[short], first + step, side="left")) if len(buf) > step else len(short)
        some = short[at:until]
        out[some] = _span_hashes(buf[first : int(ends[some[-1]])], starts[some] - first, ends[some] - first)
        at = until
    return out


def _span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """From differences of one running sum."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], dtype=U, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * M2)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive entries, in order."""
    if len(h) < n:
        return np.zeros(0, dtype=U)
    out = np.zeros(len(h) - n + 1, dtype=U)
    for k in range(n):
        out = out * U(BASE) + h[k : k + len(out)]
    return mix(out)

"""Numpy forms of column expressions, for tasks that work on whole vectors."""

from __future__ import annotations

import hashlib

import numpy as np

#: Digests that are made at once (their words stay in a core's cache), and the least number for which that is worth it.
AT_ONCE, WORTH = 1 << 14, 2_000
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The first word of the md5 digest of each head with each tail: padded blocks of 16 words (r x 16, m x 16) that add up."""
    shape = len(heads), len(tails)
    a, b, c, d, f, g = (np.full(shape, v, dtype=np.uint32) for v in (*_START, 0, 0))
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        head, tail = heads[:, _WORDS[i]], tails[:, _WORDS[i]]
        f += (tail + _SINES[i])[None, :] if tail.any() else _SINES[i]
        if head.any():
            f += head[:, None]
        np.left_shift(f, _TURNS[i], out=g)
        f >>= 32 - _TURNS[i]
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(_START[0])


def uniform_rows(tag: str, keys: list[str], n: int, first: int = 0) -> np.ndarray:
    """``columns.uniform`` of (tag, key, i) for each key (a row) and n numbers i from ``first`` on."""
    out = np.empty((len(keys), n))
    starts = [f"{tag}:{k}:".encode() for k in keys]
    sizes = np.array([len(s) for s in starts], dtype=np.int64)
    digits = len(str(first + n))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if size + digits > 55 or len(rows) * n < WORTH:  # more than a block, or few
            for r in rows.tolist():
                start = hashlib.md5(starts[r], usedforsecurity=False)
                for i in range(n):
                    h = start.copy()
                    h.update(str(first + i).encode())
                    out[r, i] = int.from_bytes(h.digest()[:4], "big")
            continue
        heads = np.zeros((len(rows), 64), dtype=np.uint8)
        heads[:, :size] = np.frombuffer(b"".join(starts[r] for r in rows.tolist()), np.uint8).reshape(len(rows), size)
        heads = heads.view("<u4").astype(np.uint32)
        lo = first
        while lo < first + n:  # numbers of as many digits
            places = len(str(lo))
            hi = min(first + n, 10**places, lo + AT_ONCE)
            tails = np.zeros((hi - lo, 64), dtype=np.uint8)
            for p in range(places):
                tails[:, size + p] = np.arange(lo, hi) // 10 ** (places - 1 - p) % 10 + 48
            tails[:, size + places] = 0x80
            tails = tails.view("<u4").astype(np.uint32)
            tails[:, 14] = 8 * (size + places)
            step = max(1, AT_ONCE // (hi - lo))
            for r in range(0, len(rows), step):
                out[rows[r : r + step], lo - first : hi - first] = _first_words(heads[r : r + step], tails).byteswap()
            lo = hi
    return out / (1 << 32)


def uniforms(tag: str, key: str, n: int, first: int = 0) -> np.ndarray:
    """The same of one key."""
    return uniform_rows(tag, [key], n, first)[0]

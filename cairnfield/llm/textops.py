"""Vectorised word and byte primitives that the Arrow-based operators share.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; the separators are ASCII, so
splitting UTF-8 bytes and splitting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the memory of the numpy intermediates, whatever a batch holds.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


#: A random odd 64-bit value for each byte; separators count as zero.
BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64)) | np.uint64(1)
BYTE_VALUE[SPACE] = 0
WORD_BASE = 0xD6E8FEB86659FD93
RUN_BASE = 0xA0761D6478BD642F


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    """Of an odd number modulo 2 ** 64."""
    return pow(base, -1, 1 << 64)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each text begins (one entry more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_FAST, _ANY = pa.Codec("zstd", compression_level=1), pa.Codec("zstd")


def squeeze(data) -> bytes:
    """Bytes (or an array's) compressed, after eight bytes that hold their size."""
    data = pa.py_buffer(data)
    return data.size.to_bytes(8, "little") + _FAST.compress(data, asbytes=True)


def unsqueeze(data) -> bytes:
    return _ANY.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def squeezed(texts: pa.Array) -> pa.Array:
    """Each text compressed on its own."""
    return pa.array([squeeze(body.as_buffer()) for body in texts.cast(pa.large_binary())], pa.binary())


def unsqueezed(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [unsqueeze(body.as_buffer()) for body in column]


def listed(values: list[bytes]) -> bytes:
    """Any byte strings as one compressed one."""
    sizes = np.fromiter(map(len, values), dtype=np.uint32, count=len(values))
    return squeeze(len(values).to_bytes(4, "little") + sizes.tobytes() + b"".join(values))


def unlisted(data) -> list[bytes]:
    whole = unsqueeze(data)
    n = int.from_bytes(whole[:4], "little")
    ends = np.cumsum(np.frombuffer(whole, dtype=np.uint32, count=n, offset=4), dtype=np.int64) + 4 * (n + 1)
    return [whole[a:b] for a, b in zip([4 * (n + 1), *ends.tolist()], ends.tolist())]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each, or one longer text."""
    _, at = raw(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``data``, and the first word of each text (one entry more)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here, or the last one has ended
    edge[at] = True
    edge[-1] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= ~inside[:-1]
    closes[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & opens)
    ends = np.flatnonzero(inside & closes) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike on every machine."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    first = int(starts[0])
    body = data[first : int(ends[-1])]
    reach = np.diff(np.append(starts, ends[-1]))
    place = np.arange(len(body)) - np.repeat(starts - first, reach)
    place = np.minimum(place, int((ends - starts).max()) - 1)  # only separators lie beyond
    with np.errstate(over="ignore"):
        value = BYTE_VALUE[body] * powers(WORD_BASE, int(place.max()) + 1)[place]
        total = np.add.reduceat(value, starts - first)
        return mix64(total + (ends - starts).astype(np.uint64) * _GOLDEN)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive entries (empty if there are fewer)."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(RUN_BASE, len(hashes)), out=total[1:])
        return mix64((total[n:] - total[:-n]) * powers(inverse(RUN_BASE), len(hashes) - n + 1))

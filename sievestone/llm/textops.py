"""Array operations over the bytes of many texts at once: Arrow columns as numpy views, spans and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse, grown by doubling."""

    up = down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


#: A 64-bit value for every byte, the same everywhere.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash reads the hash of any span of these 64-bit values."""
    up, _ = _Powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] modulo 2**64, the same wherever the span stands.  Spans may overlap, but
    should be short: from 1,024 values on there are different ones that are equal by this hash for every base."""
    _, down = _Powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


#: Places in a span for which every byte's value is in a table.
NEAR = 64


def _placed(place: np.ndarray, byte: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit value for a byte at a place in its span: unrelated for other places, so no arrangement of bytes has another's sum."""
    return mix(BYTE_VALUE[byte] + mix((place.astype(U64) + U64(seed)) * U64(0xD1342543DE82EF95)))


_TABLES = [_placed(np.repeat(np.arange(NEAR), 256), np.tile(np.arange(256), NEAR), seed) for seed in (1, 1 << 40)]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, check: bool = False) -> tuple[np.ndarray, ...]:
    """The 64-bit hash of each data[begin:end], and another one with `check`.  Spans are not empty, ascend and don't overlap.

    A hash is the sum of a value for each byte that depends on its place in the span, so unlike span_hash's polynomial it
    has no pairs of spans (such as Thue-Morse words) that are equal for every base."""
    if not len(begin):
        return (np.zeros(0, U64),) * (1 + check)
    first = np.zeros(len(data), np.int32 if len(data) < 1 << 31 else np.int64)
    first[begin] = begin
    place = np.arange(len(data), dtype=first.dtype) - np.maximum.accumulate(first)
    long = np.flatnonzero(end - begin > NEAR)
    owner, rank = spread((end - begin)[long] - NEAR)
    far = begin[long][owner] + rank + NEAR
    at = np.minimum(place, NEAR - 1)
    at <<= 8
    at += data
    edges = np.stack([begin, end], axis=1).ravel()
    out = []
    for seed, table in zip((1, 1 << 40), _TABLES[: 1 + check], strict=False):
        values = np.zeros(len(data) + 1, U64)
        np.take(table, at, out=values[:-1])
        values[far] = _placed(place[far], data[far], seed)
        out.append(mix(np.add.reduceat(values, edges)[::2] + (end - begin).astype(U64)))
    return tuple(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each).  Null is like an empty text; invalid UTF-8 is replaced by U+FFFD."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        fixed = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data, offsets = np.frombuffer(b"".join(fixed), np.uint8), np.cumsum([0, *map(len, fixed)])
    return data, offsets


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as Unicode code points, with each text's offsets among them."""
    first = (data & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=at[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), at[offsets]


def byte_places(data: np.ndarray) -> np.ndarray:
    """Where each code point begins among the bytes, and their end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the maximal runs of True that don't cross texts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 3]: owner [0, 0, 1, 1, 1] and rank within it [0, 1, 0, 1, 2]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - start[owner]


#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no white space: [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words of digits, a-z (after lower-casing) and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

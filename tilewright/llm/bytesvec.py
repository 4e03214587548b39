"""Words and their hashes for many texts at once, with numpy over the raw UTF-8 bytes.

Features of classifiers (`Hasher`) are sums of random byte values times powers of an odd number, modulo 2**64, taken from running totals
and then mixed: cheap for many overlapping pieces, but not sound where distinct pieces must not meet. Where they must not (`word_hashes`,
`windowed`), every eight bytes, and every half of a window, are mixed in before the next. Independent seeds give more bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in runs of about this many bytes, so that memory follows the longest text, not the batch.
RUN_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(max(n, 1 << 20), base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))


class Hasher:
    """Hashes of pieces of a sequence: values[i:j] for arrays of i and j."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = Powers(int(rng.integers(1 << 61, 1 << 62)) * 4 + 3)

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """values: bytes, or 64-bit numbers."""
        n = len(values)
        self.powers.reach(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.byte[values] if values.dtype == np.uint8 else values) * self.powers.up[:n], out=total[1:])
        return mixed((total[end] - total[start]) * self.powers.down[start] + (end - start).astype(np.uint64))


#: Words of up to this many bytes are hashed eight bytes at a time; longer ones are few, and go through XXH3 one by one.
SHORT = 64
#: The lowest 0 to 8 bytes of a 64-bit number.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the pieces data[start:end] of bytes."""
    size = end - start
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mixed(np.arange(SHORT + 1, dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[np.minimum(size, SHORT)]
    for k in range(0, SHORT, 8):
        todo = np.flatnonzero(size > k) if k else slice(None)
        if k and not len(todo):
            break
        out[todo] = mixed(out[todo] ^ (eight[start[todo] + k] & LOWEST[np.minimum(size[todo] - k, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes, in this order."""
    x = a * np.uint64(0xA0761D6478BD642F)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE7037ED1A0B428DB)
    x ^= x >> np.uint64(29)
    return x


def windowed(x: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of `width` consecutive hashes, from each place on (or from the places `at`), joined from powers of two of them."""
    places = slice(0, max(0, len(x) - width + 1))
    out, have, size = None, 0, 1
    while True:
        if width & size:
            part = x[places.start + have : places.stop + have] if at is None else x[at + have]
            out = part if out is None else joined(out, part)
            have += size
        size *= 2
        if size > width:
            return out
        x = joined(x[: -(size // 2)], x[size // 2 :])


def runs(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; null counts as empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + RUN_BYTES, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the row of each. at: offsets of the rows."""
    return spans(~BLANK[data], at)


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of true bytes that do not cross a row's border."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(at, start, "right") - 1


def least_of(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or by pick, greatest) of each `width` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out

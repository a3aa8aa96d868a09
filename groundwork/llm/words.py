"""Words and their hashes for whole Arrow columns of texts, without a Python step for each word.

A word is a run of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased: digits,
a-z and every byte of a code point beyond ASCII. So words can be found on UTF-8 bytes.
"""

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
GRAM = np.uint64(0xD1B54A32D192ED03)
#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 1 << 20


def mix(x):
    """A bijection that spreads every input bit over the 64 bits (finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column):
    """Bytes of an Arrow string or binary column, and where each row starts (one more than rows); null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets, size=SLICE):
    """Ranges of rows of at most `size` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, rows)
        first = last


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n):
        if len(cls.up) < n:
            n = max(n, 2 * SLICE)
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Words:
    """Words of some rows: `low` bytes, `start` and `end` of each word in them, `first` word of each row (one more than rows)."""

    def __init__(self, data, offsets):
        self.low = LOWER[data]
        rows = np.asarray(offsets, np.int64)
        is_word = IS_WORD[self.low]
        begins, ends = is_word.copy(), np.zeros(len(is_word) + 1, bool)
        begins[1:] &= ~is_word[:-1]
        inner = rows[(rows > 0) & (rows < len(is_word))]
        begins[inner] = is_word[inner]
        ends[1:-1] = is_word[:-1] & ~is_word[1:]
        ends[inner] = is_word[inner - 1]
        if len(is_word):
            ends[-1] = is_word[-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, rows)

    def hashes(self):
        """A 64-bit hash of each word, the same wherever the word stands."""
        up, down = Powers.of(len(self.low) + 1)
        sums = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:len(self.low)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def row_of(self):
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, first, last):
        """Words first to last (exclusive) as bytes, with one space between."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[first:last], self.end[first:last]))


def grams(hashes, size):
    """Hash of each run of `size` words by its first word, over row borders too; shorter by size - 1."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * GRAM + hashes[k:k + n]
    return mix(total)

"""Words and word hashes of many texts at once, on Arrow buffers with numpy.

A text column is worked on in slices of a few MB, so memory does not depend on
the size of a batch; one text longer than a slice is a slice of its own and is
never cut.
"""

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
MULT = 0x9E3779B97F4A7C15
GRAM = 0xD1342543DE82EF95


def mix(x):
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(*ranges):
    """A table of 256 flags, true for bytes in any of the inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


def not_space():
    """Bytes of ``[^\\x20\\x09-\\x0D]``."""
    return ~byte_class((0x20, 0x20), (0x09, 0x0D))


def letters_digits():
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` and A-Z, which callers fold."""
    return byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def release():
    """Give freed memory back to the system: idle workers share a machine."""
    with contextlib.suppress(Exception):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def slices(column, limit=SLICE_BYTES):
    """Yield (first row, bytes, offsets from 0) for runs of rows; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    release()


class Words:
    """Word bounds in bytes, 64-bit hashes, and each text's range of words."""

    __slots__ = ("starts", "ends", "bounds", "hash", "text_of", "total")

    def __init__(self, starts, ends, bounds, hashes, text_of, total=None):
        self.starts, self.ends, self.bounds, self.hash, self.text_of, self.total = starts, ends, bounds, hashes, text_of, total


class Hasher:
    """Hashes all words of a slice by one prefix sum of byte codes times powers.

    A word's hash is its polynomial in an odd base modulo 2**64, shifted to
    exponent 0 by the inverse power, then mixed.
    """

    def __init__(self, is_word, fold_case=True, replace=None):
        self.is_word = is_word
        code = np.arange(256, dtype=np.uint64)
        if fold_case:
            code[0x41:0x5B] += np.uint64(0x20)
        for a, b in (replace or {}).items():
            code[ord(a)] = ord(b)
        self.code = mix((code + np.uint64(1)) * np.uint64(MULT))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n):
        if len(self.power) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, base in (("power", MULT), ("inverse", pow(MULT, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def words(self, data, offsets):
        n = len(data)
        count = len(offsets) - 1
        if not n:
            none = np.zeros(0, np.int64)
            return Words(none, none, np.zeros(count + 1, np.int64), np.zeros(0, np.uint64), none)
        w = self.is_word[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = w[:-1]
        first = offsets[:-1]
        before[first[first < n]] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = w[1:]
        after[first[first > 0] - 1] = False
        starts = np.flatnonzero(w & ~before)
        ends = np.flatnonzero(w & ~after) + 1
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self.inverse[starts])
        bounds = np.searchsorted(starts, offsets)
        text_of = np.repeat(np.arange(count), np.diff(bounds))
        return Words(starts, ends, bounds, hashes, text_of, total)

    def heads(self, words, n):
        """(indices of words of n bytes or more, hash of their first n bytes)."""
        at = np.flatnonzero(words.ends - words.starts >= n)
        s = words.starts[at]
        if not len(at):
            return at, np.zeros(0, np.uint64)
        return at, mix((words.total[s + n] - words.total[s]) * self.inverse[s] + np.uint64(n))

    def one(self, text):
        """Hashes of the words of one Python string."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.words(b, np.array([0, len(b)])).hash


def grams(hashes, k, seed=0):
    """Hash of each run of k hashes; runs across texts are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] + np.uint64(seed)
    for j in range(1, k):
        out = out * np.uint64(GRAM) + hashes[j : j + n]
    return mix(out)


def whole(words, k):
    """Indices of words at which a run of k words of one text starts."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.text_of[:n] == words.text_of[k - 1 :])


def signed(x):
    return x.view(np.int64)

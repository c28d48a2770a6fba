"""Many texts at once as one array of code points: classes, runs and hashes, without a Python object for each word.

Hashes of runs come from prefix sums of a polynomial modulo 2^64, so that any run of any array costs the same. Words seen
before are found in a table by hash; only new ones are looked at as strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np

#: Code points from here on belong to no class.
LIMIT = 0x33480
#: Stands between texts; blank, so that no pattern crosses it.
SEPARATOR = "\n\x1e\n"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def class_table(*members: Callable[[str], bool] | Iterable[str]) -> np.ndarray:
    """Bit i of entry c says whether code point c is in class i, given as a test or as characters."""
    table = np.zeros(LIMIT + 1, np.uint8)
    for bit, member in enumerate(members):
        if callable(member):
            held = np.fromiter((member(chr(c)) for c in range(LIMIT)), bool, LIMIT)
            table[:-1][held] |= 1 << bit
        else:
            for c in member:
                table[ord(c)] |= 1 << bit
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    return table[np.minimum(code, LIMIT)]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of every run of true values."""
    turn = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return turn[::2], turn[1::2]


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs first..last: the number of the run and the position of every element."""
    size = last - first
    run = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    return run, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


def mixed(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64)
    v ^= v >> np.uint64(31)
    v *= _MIX
    v ^= v >> np.uint64(29)
    return v


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of values[first:last] for every run."""
    n = len(values)
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(values) * _powers[0][:n], out=total[1:])
    if not len(first):
        return np.zeros(0, np.uint64)
    h = (total[last] - total[first]) * _powers[1][first]
    return mixed(h + (last - first).astype(np.uint64)) | np.uint64(1)


def hash_of(word: str) -> int:
    """A 64-bit hash of a word, never 0."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1


class HashTable:
    """Row numbers by 64-bit key (not 0), with open addressing."""

    def __init__(self, rows: int = 1 << 19):
        self.shift = np.uint64(64 - max(4, int(2 * rows - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.rows, self.mask, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int32), size - 1, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.rows[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Put in distinct keys that aren't there yet."""
        self.used += len(keys)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]  # of several keys for one slot one stays
            self.rows[slot[free]] = rows[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask


class WordTable:
    """Columns of facts about words, by hash of the word as it stands; facts come from a function, once for each new word."""

    def __init__(self, facts: Callable[[str], tuple], kinds: tuple, most: int = 400_000):
        self.facts, self.kinds, self.most = facts, kinds, most
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable(self.most)
        self.columns = [np.zeros(1 << 12, k) for k in self.kinds]
        self.words = 0

    def rows(self, text: str, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each word text[first:last]."""
        row = self.table.find(hashes)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            fresh, at = np.unique(hashes[miss], return_index=True)
            if self.words + len(fresh) > self.most:
                self.most = max(self.most, 2 * len(fresh))  # a batch may bring more new words than a table was made for
                self._clear()
                return self.rows(text, first, last, hashes)
            told = [self.facts(text[a:z]) for a, z in zip(first[miss[at]].tolist(), last[miss[at]].tolist())]
            upto = self.words + len(fresh)
            for i, column in enumerate(self.columns):
                if upto > len(column):
                    self.columns[i] = column = np.concatenate((column, np.zeros(max(upto, len(column)), column.dtype)))
                column[self.words : upto] = [t[i] for t in told]
            self.table.add(fresh, np.arange(self.words, upto, dtype=np.int32))
            self.words = upto
            row[miss] = self.table.find(hashes[miss])
        return row

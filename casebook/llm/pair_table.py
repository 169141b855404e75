"""Ranks of symbol pairs in a two-choice hash table, looked up for whole arrays."""

from __future__ import annotations

import numpy as np

NO_PAIR = np.iinfo(np.int32).max
EMPTY = np.uint32(0xFFFFFFFF)
KICKS = 200
U = np.uint32


class PairTable:
    """(left, right) -> rank.  Every pair stands in one of two places, so a lookup reads two."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, base: int):
        if base * base > int(EMPTY):
            raise ValueError("more symbols than fit a 32-bit pair")
        self.base = U(base)
        keys = left.astype(U) * self.base + right.astype(U)
        bits = max(4, int(2.5 * len(keys)).bit_length())
        rng = np.random.default_rng(7)
        while True:
            self.shift = U(32 - bits)
            self.odd = [U(x) for x in rng.integers(0, 1 << 31, 2, dtype=np.uint64) * 2 + 1]
            if self._fill(keys.tolist(), rank.tolist(), 1 << bits):
                return
            bits = min(bits + 1, 30)

    def _fill(self, keys: list[int], ranks: list[int], size: int) -> bool:
        table, value = [int(EMPTY)] * size, [int(NO_PAIR)] * size
        places = [((np.array(keys, dtype=U) * odd) >> self.shift).tolist() for odd in self.odd]
        home = {k: (a, b) for k, a, b in zip(keys, *places)}
        for key, rank in zip(keys, ranks):
            at = home[key][0]
            for _ in range(KICKS):
                key, table[at] = table[at], key
                rank, value[at] = value[at], rank
                if key == EMPTY:
                    break
                a, b = home[key]
                at = b if at == a else a
            else:
                return False
        self.keys, self.value = np.array(table, dtype=U), np.array(value, dtype=np.int32)
        return True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair (uint32 symbols), ``NO_PAIR`` where there is none."""
        key = left * self.base + right
        first, second = ((key * odd) >> self.shift for odd in self.odd)
        found = self.keys[first] == key
        at = np.where(found, first, second)
        return np.where(found | (self.keys[at] == key), self.value[at], np.int32(NO_PAIR))

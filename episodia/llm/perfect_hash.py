"""A minimal perfect hash over a bounded set of keys, with the keys stored at their slots.

Levels of bit arrays: a key that is alone at its place of a level takes that
place, the others go on to the next level; the rank of the place among all taken
ones is the slot.  About three bits a key, and slots 0 .. n - 1.  A key outside
the set lands on some slot too, so every lookup compares the stored key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from episodia.llm.textkernel import mix, range_hash

U64 = np.uint64
SPREAD = 2  # places of a level for each key that enters it


def key_hashes(keys: pa.Array, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the keys' bytes; another salt gives unrelated ones."""
    keys = keys.cast(pa.large_binary())
    _, offsets, data = keys.buffers()
    at = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(keys) else np.zeros(0, np.uint8)
    return range_hash(raw ^ np.uint8(salt), at[:-1] - at[:1], at[1:] - at[:1])


class PerfectHash:
    """``slots`` of keys; ``keys`` holds the set in slot order."""

    def __init__(self, candidates: pa.Array):
        for salt in range(256):
            hashes = key_hashes(candidates, salt)
            if len(np.unique(hashes)) == len(hashes):  # equal hashes never part: take other ones
                break
        else:
            raise ValueError("the candidates are not distinct")
        self.salt, self.levels, begin = salt, [], 0
        left = hashes
        while len(left):
            places = self._places(left, len(self.levels), SPREAD * len(left))
            alone = np.bincount(places, minlength=SPREAD * len(left)) == 1
            rank = np.cumsum(alone) - 1 + begin
            self.levels.append((alone, rank))
            begin += int(alone.sum())
            left = left[~alone[places]]
        slots = self._slots(hashes)
        order = np.empty(len(slots), np.int64)
        order[slots] = np.arange(len(slots))
        self.keys = candidates.take(pa.array(order))

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(size)).astype(np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (alone, rank) in enumerate(self.levels):
            places = self._places(hashes[left], level, len(alone))
            hit = alone[places]
            out[left[hit]] = rank[places[hit]]
            left = left[~hit]
        return out

    def slots(self, keys: pa.Array) -> np.ndarray:
        """The slot of each key, -1 for keys outside the set."""
        found = self._slots(key_hashes(keys, self.salt))
        if not len(self):
            return found
        same = pc.equal(self.keys.take(pa.array(np.maximum(found, 0))), keys).to_numpy(zero_copy_only=False)
        return np.where(same, found, -1)

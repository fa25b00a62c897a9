"""A cuckoo filter over 64-bit hashes in numpy, with whole batches inserted, removed and probed at once.

Partial-key cuckoo hashing after Fan, Andersen, Kaminsky and Mitzenmacher (CoNEXT 2014): 4 slots a bucket, 16-bit
fingerprints, the second bucket found from the first and the fingerprint alone, so that entries can move and be deleted.
"""

from __future__ import annotations

import numpy as np

from regscope.llm.common import mix

SLOTS = 4
FILL = 0.8
KICKS = 400


class CuckooFilter:
    """Holds distinct hashes; ``contains`` never misses one that is in, and rarely says yes to one that is not."""

    def __init__(self, capacity: int) -> None:
        buckets = 1
        while buckets * SLOTS * FILL < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)  # 0: free

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(16, len(keys))
        while True:
            made = cls(size)
            if made.add(keys):
                return made
            size *= 2

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _print(self, keys: np.ndarray) -> np.ndarray:
        return ((mix(keys) >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one = self._print(keys), self._first(keys)
        two = self._other(one, mark)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which ones found a place."""
        order = np.argsort(bucket, kind="stable")
        where = bucket[order]
        start = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        rank = np.arange(len(where)) - np.repeat(start, np.diff(np.concatenate((start, [len(where)]))))
        free = self.table[where] == 0
        fits = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) > rank[:, None]).argmax(axis=1)
        self.table[where[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(bucket), bool)
        done[order[fits]] = True
        return done

    def add(self, keys: np.ndarray) -> bool:
        """Insert distinct new keys. False: too full; the filter is then spoilt and is to be rebuilt larger."""
        mark = self._print(keys)
        bucket = self._first(keys)
        for turn in range(KICKS):
            if not len(mark):
                return True
            done = self._settle(bucket, mark)
            bucket, mark = bucket[~done], mark[~done]
            if turn % 2 and len(mark):  # both buckets are full: one waiting mark a bucket takes another's slot
                where, at = np.unique(bucket, return_index=True)
                slot = (mix(mark[at].astype(np.uint64) + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
                mark[at], self.table[where, slot] = self.table[where, slot], mark[at]
            bucket = self._other(bucket, mark)
        return not len(mark)

    def _clear(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Free one slot of its bucket for each mark that is there; which ones were found."""
        order = np.lexsort((mark, bucket))
        where, what = bucket[order], mark[order]
        start = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (what[1:] != what[:-1]))))
        rank = np.arange(len(where)) - np.repeat(start, np.diff(np.concatenate((start, [len(where)]))))
        same = self.table[where] == what[:, None]
        found = rank < same.sum(axis=1)
        slot = (np.cumsum(same, axis=1) > rank[:, None]).argmax(axis=1)
        self.table[where[found], slot[found]] = 0
        done = np.zeros(len(bucket), bool)
        done[order[found]] = True
        return done

    def remove(self, keys: np.ndarray) -> None:
        """Delete distinct keys that are in the filter; deleting others may drop a key of the same print."""
        mark, bucket = self._print(keys), self._first(keys)
        left = ~self._clear(bucket, mark)
        self._clear(self._other(bucket[left], mark[left]), mark[left])

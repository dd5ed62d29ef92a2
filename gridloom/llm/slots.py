"""Minimal perfect hashing in numpy, and byte strings packed into one buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes, mixed anew for each salt."""
    x = h + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..m-1 for m distinct 64-bit hashes. On each level the keys that are left are thrown at
    twice as many bits; those alone on theirs stay. A key's slot is the number of bits set before its
    own. A hash outside the set gets some slot or none: callers compare the stored key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.cumsum(b, dtype=np.int32) for b in levels]

    @classmethod
    def of(cls, h: np.ndarray) -> PerfectHash:
        levels, left = [], h
        while len(left):
            size = max(64, 2 * len(left))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The slots of hashes, -1 where no level has their bit."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for k, bits in enumerate(self.levels):
            at = (mixed(h[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]] - 1
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.array([len(b) for b in self.levels], np.int64).tobytes(), b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, lo = [], 0
        for n in np.frombuffer(sizes, np.int64).tolist():
            hi = lo + (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits[lo:hi], np.uint8), count=n).astype(bool))
            lo = hi
        return cls(levels)


def packed(keys: pa.Array) -> tuple[bytes, bytes]:
    """Ends and bytes of a column of byte strings."""
    keys = pa.concat_arrays([keys.cast(pa.binary())])
    ends = np.cumsum(pc.binary_length(keys).to_numpy(zero_copy_only=False), dtype=np.int32)
    return ends.tobytes(), b"".join(keys.to_pylist())


def unpacked(ends: bytes, data: bytes) -> pa.Array:
    at = np.concatenate([np.zeros(1, np.int32), np.frombuffer(ends, np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def counted(keys: pa.Array, counts: np.ndarray) -> bytes:
    """Keys and their counts in one compressed string; keys in order, which compresses best."""
    order = pc.sort_indices(keys)
    ends, data = packed(keys.take(order))
    sizes = np.diff(np.frombuffer(ends, np.int32), prepend=np.int32(0)).astype(np.int32)
    raw = len(keys).to_bytes(8, "little") + sizes.tobytes() + counts[order.to_numpy()].astype(np.int64).tobytes() + data
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def uncounted(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    sizes, counts = np.frombuffer(raw, np.int32, n, 8), np.frombuffer(raw, np.int64, n, 8 + 4 * n)
    return unpacked(np.cumsum(sizes, dtype=np.int32).tobytes(), raw[8 + 12 * n :]), counts


class StoredKeys:
    """A perfect hash with its keys in the order of their slots. Keys whose hash another key has
    already come after them, found by their bytes."""

    def __init__(self, hashing: PerfectHash, keys: pa.Array):
        self.hashing, self.keys = hashing, keys
        self.extra = {k: i for i, k in enumerate(keys[int(hashing.before[-1]) :].to_pylist(), int(hashing.before[-1]))}

    def __len__(self) -> int:
        return len(self.keys)

    @classmethod
    def of(cls, h: np.ndarray, keys: pa.Array) -> StoredKeys:
        """Of keys that may repeat."""
        if not len(h):
            return cls(PerfectHash([]), keys)
        unique, first = np.unique(h, return_index=True)
        own = keys.take(pa.array(first))
        same = pc.equal(own.take(pa.array(np.searchsorted(unique, h))), keys).to_numpy(zero_copy_only=False)
        extra = sorted(set(keys.take(pa.array(np.flatnonzero(~same))).to_pylist()))
        hashing = PerfectHash.of(unique)
        order = np.empty(len(unique), np.int64)
        order[hashing(unique)] = np.arange(len(unique))
        return cls(hashing, pa.concat_arrays([own.take(pa.array(order)), pa.array(extra, pa.binary())]))

    def __call__(self, h: np.ndarray, keys: pa.Array) -> np.ndarray:
        """The slots of keys, -1 of keys that aren't stored."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        slot = self.hashing(h)
        same = (slot >= 0) & pc.equal(self.keys.take(pa.array(np.maximum(slot, 0))), keys).to_numpy(zero_copy_only=False)
        slot[~same] = -1
        if self.extra and not same.all():
            at = np.flatnonzero(~same)
            slot[at] = [self.extra.get(k, -1) for k in keys.take(pa.array(at)).to_pylist()]
        return slot

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        return *self.hashing.dump(), *packed(self.keys)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, ends: bytes, data: bytes) -> StoredKeys:
        return cls(PerfectHash.load(sizes, bits), unpacked(ends, data))

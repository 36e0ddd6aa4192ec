"""Sorted 64-bit keys and what belongs to them as compressed blobs, dealt by the top bits of the key."""

from __future__ import annotations

import numpy as np
import zstandard

_DEFLATE, _INFLATE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of a public 64-bit hash)."""
    x = (x ^ (x >> _S)) * _C1
    x = (x ^ (x >> _S)) * _C2
    return x ^ (x >> _S)


def order_of(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of 64-bit keys. Keys that carry their place in their low bits are sorted as plain numbers, which is several times as fast; those of equal high
    bits that differ below are put in order afterwards, and are few where keys are hashes."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    sorted_ = np.sort(keys & ~low | np.arange(len(keys), dtype="u8"))
    order, high = (sorted_ & low).astype("i8"), sorted_ & ~low
    near = high[1:] == high[:-1]
    unlike = near & (keys[order[1:]] != keys[order[:-1]])
    if unlike.any():
        group = np.cumsum(np.concatenate([[True], ~near]))
        odd = np.zeros(group[-1] + 1, bool)
        odd[group[1:][unlike]] = True
        at = np.flatnonzero(odd[group])
        order[at] = order[at][np.lexsort((order[at], keys[order[at]], group[at]))]
    return order


def packed(values: np.ndarray) -> bytes:
    """An integer array, its bytes regrouped by significance."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view("u1").reshape(-1, values.itemsize).T)
    return _DEFLATE.compress(planes.tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_INFLATE.decompress(blob), "u1").reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8"), dtype="u8")


def bucket_bits(parts: int) -> int:
    """Buckets are a power of two, no fewer than parts."""
    return max(1, (max(2, parts) - 1).bit_length())


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket starts in the sorted keys, and the end."""
    edges = np.arange(1 << bits, dtype="u8") << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, edges), len(keys))


def compressed(data: bytes) -> bytes:
    return _DEFLATE.compress(data)


def decompressed(data: bytes) -> bytes:
    return _INFLATE.decompress(data)

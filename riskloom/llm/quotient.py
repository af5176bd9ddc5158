"""Counting quotient filters without loss: packed n-grams, permuted, kept as quotients and whole remainders."""

from __future__ import annotations

import struct

import numpy as np

# Odd factors of the permutation; any odd numbers make one.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
HEADER = struct.Struct("<IBBI")


class Packing:
    """N-grams of word ids of ``bits`` bits as keys, and the permutation that spreads the keys evenly.

    A key is a few lanes of whole ids, 64 bits each at most. The permutation works on the first lane, with the others
    mixed in, and can be undone: nothing is lost, unlike with a hash.
    """

    def __init__(self, length: int, bits: int):
        if not 1 <= bits <= 64:
            raise ValueError("a word id has 1 to 64 bits")
        self.length, self.bits = length, bits
        self.per_lane = min(length, 64 // bits)
        self.lanes = -(-length // self.per_lane)
        self.width = self.per_lane * bits
        self.mask = np.uint64((1 << self.width) - 1)
        self.shift = np.uint64((self.width + 1) // 2)

    def _others(self, keys: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(keys), np.uint64)
        for lane in range(1, self.lanes):
            mixed = (mixed ^ keys[:, lane]) * np.uint64(FACTORS[0])
            mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(FACTORS[1]) >> np.uint64(64 - self.width)) & self.mask

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Permuted keys, a row of lanes each, of the rows of word ids."""
        words = words.astype(np.uint64)
        keys = np.zeros((len(words), self.lanes), np.uint64)
        for at in range(self.length):
            lane = at // self.per_lane
            keys[:, lane] |= words[:, at] << np.uint64(at % self.per_lane * self.bits)
        first = keys[:, 0] ^ self._others(keys)
        for factor in FACTORS:
            first = (first * np.uint64(factor)) & self.mask
            first ^= first >> self.shift
        keys[:, 0] = first
        return keys

    def words(self, keys: np.ndarray) -> np.ndarray:
        """The word ids of permuted keys."""
        first = keys[:, 0]
        for factor in reversed(FACTORS):
            first = first ^ (first >> self.shift)
            first = (first * np.uint64(pow(factor, -1, 1 << self.width))) & self.mask
        plain = keys.copy()
        plain[:, 0] = first ^ self._others(keys)
        one = np.uint64((1 << self.bits) - 1)
        found = [
            (plain[:, at // self.per_lane] >> np.uint64(at % self.per_lane * self.bits)) & one for at in range(self.length)
        ]
        return np.stack(found, axis=1)

    def shard(self, keys: np.ndarray, shard_bits: int) -> np.ndarray:
        """The leading bits of the quotient."""
        if not shard_bits:
            return np.zeros(len(keys), np.int64)
        return (keys[:, 0] >> np.uint64(self.width - shard_bits)).astype(np.int64)


def sort_count(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and the number of each row's key among them."""
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    if not len(keys):
        return keys, np.zeros(0, np.int64), number
    if counts is None:
        return ordered[starts], np.diff(np.append(starts, len(keys))), number
    return ordered[starts], np.add.reduceat(counts[order], starts), number


def _bytes_of(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _values_of(body: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(body, np.uint8, n * size).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


class QuotientFilter:
    """Sorted distinct keys of one shard with their counts.

    As bytes, the first lane after its shard bits is a quotient, kept as the number of keys of each
    quotient, and a remainder in as few bytes as it needs, beside the other lanes; a count takes one byte, from 255 on eight more.
    """

    def __init__(self, packing: Packing, shard: int, shard_bits: int, keys: np.ndarray, counts: np.ndarray):
        self.packing, self.shard, self.shard_bits = packing, shard, shard_bits
        self.keys, self.counts = keys, counts

    def to_bytes(self) -> bytes:
        held, n = self.packing, len(self.keys)
        rest = held.width - self.shard_bits
        quotient_bits = min(rest, max(n.bit_length() - 1, 0))
        tail = rest - quotient_bits
        first = self.keys[:, 0] & np.uint64((1 << rest) - 1)
        quotient = (first >> np.uint64(tail)).astype(np.int64) if quotient_bits else np.zeros(n, np.int64)
        filled = np.bincount(quotient, minlength=1 << quotient_bits)
        wide = 1 if n == 0 or filled.max() < 256 else 4
        large = self.counts >= 255
        parts = [
            HEADER.pack(n, quotient_bits, wide, int(large.sum())), filled.astype(f"<u{wide}").tobytes(),
            _bytes_of(first & np.uint64((1 << tail) - 1), -(-tail // 8)),
            *(_bytes_of(self.keys[:, lane], -(-held.width // 8)) for lane in range(1, held.lanes)),
            np.where(large, 255, self.counts).astype(np.uint8).tobytes(), self.counts[large].astype("<i8").tobytes(),
        ]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, packing: Packing, shard: int, shard_bits: int, content: bytes) -> QuotientFilter:
        n, quotient_bits, wide, n_large = HEADER.unpack_from(content)
        body = memoryview(content)[HEADER.size :]
        filled = np.frombuffer(body, f"<u{wide}", 1 << quotient_bits).astype(np.int64)
        body = body[wide << quotient_bits :]
        rest = packing.width - shard_bits
        tail = rest - quotient_bits
        keys = np.zeros((n, packing.lanes), np.uint64)
        size = -(-tail // 8)
        keys[:, 0] = _values_of(body, n, size)
        body = body[n * size :]
        if quotient_bits:
            keys[:, 0] |= np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), filled) << np.uint64(tail)
        if shard_bits:
            keys[:, 0] |= np.uint64(shard << rest)
        size = -(-packing.width // 8)
        for lane in range(1, packing.lanes):
            keys[:, lane] = _values_of(body, n, size)
            body = body[n * size :]
        counts = np.frombuffer(body, np.uint8, n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(body[n:], "<i8", n_large)
        return cls(packing, shard, shard_bits, keys, counts)


def cut_in_shards(packing: Packing, keys: np.ndarray, counts: np.ndarray, shard_bits: int) -> list[QuotientFilter]:
    """One filter per shard that has keys; ``keys`` are distinct and sorted."""
    if not len(keys):
        return []
    shards = packing.shard(keys, shard_bits)
    starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    return [
        QuotientFilter(packing, int(shards[a]), shard_bits, keys[a:b], counts[a:b])
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)
    ]


def merge(filters: list[QuotientFilter]) -> tuple[QuotientFilter, list[np.ndarray]]:
    """The summed filter of one shard, and for each given one the numbers of its keys in it."""
    first = filters[0]
    keys, counts, number = sort_count(
        np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters]))
    cuts = np.cumsum([len(f.keys) for f in filters])[:-1]
    return QuotientFilter(first.packing, first.shard, first.shard_bits, keys, counts), np.split(number, cuts)

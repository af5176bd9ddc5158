"""Repeatable pseudo-random draws: a function of the row's key, never of row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32
BUCKET_BITS = 16


def key_hash(key: Column, seed: int | str) -> Column:
    """A 32-bit hash of the key and the seed. md5 so that other engines can repeat it."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_bucket(hashed: Column) -> Column:
    """The leading bits of a hash: evenly filled buckets in hash order."""
    return F.shiftright(hashed, HASH_BITS - BUCKET_BITS)


def uniform(key: Column, salt: str) -> Column:
    """A draw from [0, 1) for the key."""
    return key_hash(key, salt) / F.lit(float(2**HASH_BITS))


def choose(key: Column, salt: str, shares: dict[str, float]) -> Column:
    """One of the named values, drawn with the given shares."""
    draw, reached, names = uniform(key, salt), 0.0, list(shares)
    chosen = None
    for name in names[:-1]:
        reached += shares[name]
        condition = draw < reached
        chosen = F.when(condition, F.lit(name)) if chosen is None else chosen.when(condition, F.lit(name))
    last = F.lit(names[-1])
    return last if chosen is None else chosen.otherwise(last)

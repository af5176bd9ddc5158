"""Join a per-group result back to the rows of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
MAX_BROADCAST_GROUPS = 1024


def attach(
    rows: DataFrame,
    per_group: DataFrame,
    by: list[str],
    spread_on: str,
    how: str = "inner",
    groups: int | None = None,
) -> DataFrame:
    """Join the one row per group of ``per_group`` to ``rows``, even where groups are few and huge.

    ``groups`` states how many groups there can be, where the caller knows; up to
    ``MAX_BROADCAST_GROUPS`` rows are broadcast as they are. Otherwise the small side is repeated
    once per salt, so no task receives a whole group; where its measured size allows, Spark turns
    that join into a broadcast one too. ``spread_on`` is any column that varies inside a group.
    """
    bound = groups if by else 1
    if bound is not None and bound <= MAX_BROADCAST_GROUPS:
        if not by:
            return rows.join(F.broadcast(per_group), F.lit(True), how)
        return rows.join(F.broadcast(per_group), by, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(SALTS)).cast("int"))
    copies = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*by, "_salt"], how).drop("_salt")

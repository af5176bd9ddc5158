"""Connected components of a link table, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; component is its smallest node.

    Rounds of two steps: each link's lower end is replaced by the smallest node that end is
    linked to, then all lower ends of a node are linked to the smallest of them. The links
    become stars in a logarithmic number of rounds. Every step is a partial minimum per node
    and a join on plain written tables, so a node with very many links is combined before the
    shuffle and its join partition can be split by adaptive execution. Links go to the shared
    folder each round: a lost executor redoes one step only. Nulls in either end are no link.
    """
    links = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    before = _state(links)
    while before[0]:
        lowest = materialize(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "lowest")
        hooked = materialize(
            links.join(lowest, links.v == lowest.node, "left")
            .select("u", F.coalesce("low", "v").alias("v"))
            .distinct(),
            "links",
        )
        lowest = materialize(hooked.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "lowest")
        links = materialize(
            hooked.join(lowest, hooked.u == lowest.node)
            .select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
                    F.col("low").alias("v"))
            .distinct(),
            "links",
        )
        after = _state(links)
        if after == before:
            break
        before = after
    heads = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)

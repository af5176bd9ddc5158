"""Exact order statistics without a single-partition sort.

``Window.orderBy`` without a partition key sends a whole group to one task. The helpers here
cut each group into value-ordered buckets first, take prefix sums inside the buckets and add
the offset of the buckets below, which is a join on the same keys and costs no extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .attach import attach

OUTER_CELLS = 16
INNER_CELLS = 32
SKETCH_ACCURACY = 10_000


def _bucket_edges(distinct: DataFrame, by: list[str], value: str) -> DataFrame:
    """Balanced bucket edges per group, as a coarse list and, per coarse cell, a fine list.

    The edges are approximate quantiles of the distinct values: a sketch per group and task,
    merged, so neither the values nor a sample of them meet in one task. Results are exact
    whatever the edges are; they only balance the buckets.
    """
    cells = OUTER_CELLS * INNER_CELLS
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    edges = distinct.groupBy(*by).agg(F.percentile_approx(value, shares, SKETCH_ACCURACY).alias("_edges"))
    coarse = F.transform(
        F.sequence(F.lit(1), F.lit(OUTER_CELLS - 1)),
        lambda i: F.element_at("_edges", (i * INNER_CELLS).cast("int")),
    )
    fine = F.transform(
        F.sequence(F.lit(0), F.lit(OUTER_CELLS - 1)),
        lambda i: F.slice("_edges", i * INNER_CELLS + 1, INNER_CELLS - 1),
    )
    return edges.select(*by, coarse.alias("_coarse"), fine.alias("_fine"))


def _below(edges: Column, value: str) -> Column:
    return F.size(F.filter(edges, lambda e: e <= F.col(value)))


def value_steps(
    df: DataFrame, by: list[str], value: str, weights: dict[str, Column], groups: int | None = None
) -> DataFrame:
    """Per group and distinct value: summed weights, inclusive running sums and group totals.

    ``weights`` maps a name to a per-row column; the result has ``name``, ``name_cum`` and
    ``name_all``. Rows whose value is null are ignored. Equal values share one row, so ties
    are handled exactly, and repeated values are combined before anything is shuffled.

    ``groups`` states how many groups there can be, where the caller knows (one per model, one
    per column). The edges, some 64 KB per group, are then broadcast; otherwise Spark decides by size.
    """
    names = list(weights)
    anchor = [] if by else ["_whole"]
    keys = by or anchor
    narrowed = df.filter(F.col(value).isNotNull()).select(
        *by, *[F.lit(0).alias(a) for a in anchor], value, *[c.alias(n) for n, c in weights.items()]
    )
    distinct = materialize(narrowed.groupBy(*keys, value).agg(*[F.sum(n).alias(n) for n in names]), "distinct-values")

    edges = materialize(_bucket_edges(distinct, keys, value), "bucket-edges")
    outer = _below(F.col("_coarse"), value)
    placed = (
        attach(distinct, edges, keys, spread_on=value, groups=groups if by else 1)
        .withColumn("_outer", outer)
        .withColumn("_bucket", F.col("_outer") * INNER_CELLS + _below(F.element_at("_fine", F.col("_outer") + 1), value))
        .select(*keys, "_bucket", value, *names)
    )

    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"{n}_below") for n in names],
            *[F.sum(n).over(whole).alias(f"{n}_all") for n in names],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = placed.select("*", *[F.sum(n).over(inside).alias(f"{n}_inside") for n in names])
    return running.join(offsets, [*keys, "_bucket"]).select(
        *by,
        value,
        *names,
        *[(F.col(f"{n}_inside") + F.col(f"{n}_below")).alias(f"{n}_cum") for n in names],
        *[f"{n}_all" for n in names],
    )


def order_statistics(
    df: DataFrame, by: list[str], value: str, probabilities: dict[str, float], groups: int | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry.

    The position of a quantile is known once the group size is, so each is a conditional
    minimum over the running counts: no task holds the values of a group.
    """
    steps = value_steps(df, by, value, {"rows": F.lit(1)}, groups)
    aggregates = []
    for name, p in probabilities.items():
        position = (F.col("rows_all") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggregates.append(
                F.min(F.when(F.col("rows_cum") > rank, F.col(value).cast("double"))).alias(f"{name}_{side}")
            )
    found = steps.groupBy(*by).agg(F.max("rows_all").alias("_n"), *aggregates)

    def interpolate(name: str, p: float) -> Column:
        position = (F.col("_n") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low + (high - low) * share).alias(name)

    return found.select(*by, *[interpolate(n, p) for n, p in probabilities.items()])


def rank_within(
    df: DataFrame, by: list[str], bucket: Column, order: list[Column], limit: int | None = None
) -> DataFrame:
    """1-based ``rank`` of each row and the ``group_size``, for an order that refines ``bucket``.

    ``bucket`` must be non-decreasing in the order and spread rows evenly, for instance the
    leading bits of a hash of a unique key. With ``limit`` only the first rows of each group
    are kept, and buckets that lie wholly beyond it are dropped before anything is sorted.
    """
    keys = by or ["_whole"]
    placed = df.withColumn("_bucket", bucket)
    if not by:
        placed = placed.withColumn("_whole", F.lit(0))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .count()
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_below"),
            F.sum("count").over(Window.partitionBy(*keys)).alias("group_size"),
        )
    )
    if limit is not None:
        offsets = offsets.filter(F.col("_below") < limit)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = placed.join(offsets, [*keys, "_bucket"]).withColumn("_inside", F.row_number().over(inside))
    out = ranked.withColumn("rank", F.col("_inside") + F.col("_below"))
    if limit is not None:
        out = out.filter(F.col("rank") <= limit)
    return out.drop("_bucket", "_inside", "_below", *([] if by else ["_whole"]))

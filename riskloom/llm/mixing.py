"""Mix sources to target weights by weighted fair queueing, on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.llm.tables import free_name, word_count
from riskloom.session import materialize

LANES = 4096  # parts of a source's queue; a part's rows are what one task orders
TICKS = 4096  # parts of one unit of virtual time
LAST_TICK = 4 * TICKS


def queue_key(doc_id: Column, seed: str = "mix") -> Column:
    """Place of a document in its source's queue: the md5 of seed and id, null written ``null``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def targets(totals: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Add ``rank``, ``total`` and ``target`` to ``totals(name, missing, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn. Targets share ``share`` of
    all sizes by weight; none exceeds ``most`` times its source, and what is cut off is shared
    again. Filled in order of size per weight, the sources that stop at their bound come first;
    the first source that does not reach its bound gives the level for all that follow. These
    windows see one row per source, never documents.
    """
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy("missing", "name")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = W.partitionBy(F.lit(0))
    fill = everything.orderBy(F.col("source_size") / F.col("weight"), "rank")
    earlier = fill.rowsBetween(W.unboundedPreceding, -1)
    return (
        ranked.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("step", F.row_number().over(fill))
        .withColumn("full", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("level", (share * F.col("total") - most * F.col("full")) / F.col("open"))
        .withColumn("reached", F.col("level") * F.col("weight") <= most * F.col("source_size"))
        .withColumn("first", F.min(F.when(F.col("reached"), F.struct("step", "level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("first").isNull() | (F.col("step") < F.col("first.step")), most * F.col("source_size"))
            .otherwise(F.col("first.level") * F.col("weight")),
        )
        .select("name", "missing", "source_size", "rank", "total", "target")
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix"
) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source, ...)``.

    Result: ``doc_id, place, name, missing, size, source_size, target, taken``. A document's
    virtual finish time is the running size of its shuffled source divided by the source's target;
    the queue runs through the source up to ``repeats`` times. All copies in order of finish time
    are taken until their sizes pass the budget, whole copies only.

    A source's queue is cut into parts by the shuffle key and an order over all copies into ticks of
    virtual time, so the largest source is summed by part before rows are ordered and no task
    orders more than one part or the one tick in which the budget ends. Only that tick's last
    copy, a single row, comes to the driver.

    Null or empty texts have size 0 and are not taken; null sources form one source, ranked last.
    Rows equal in id, source and size are taken alike. Repeated ids are separate documents. No rows
    give no rows. The result depends on the data and the seed alone.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id"), F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("missing"),
            word_count(F.col("text")).alias("size"), queue_key(F.col("doc_id"), seed).alias("place"),
        ).withColumn("lane", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")),
        "sizes",
    )
    lanes = materialize(
        sized.groupBy("name", "missing", "lane").agg(F.sum("size").alias("lane_size")), "lanes"
    )
    plan = materialize(
        targets(lanes.groupBy("name", "missing").agg(F.sum("lane_size").alias("source_size")), weights, share,
                float(repeats)),
        "targets",
    )
    before = W.partitionBy("name", "missing").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    offsets = lanes.withColumn("ahead", F.coalesce(F.sum("lane_size").over(before), F.lit(0))).join(
        plan, ["name", "missing"]
    )
    inside = W.partitionBy("name", "missing", "lane").orderBy("place", "doc_id", "size")
    queued = materialize(
        sized.withColumn("own", F.sum("size").over(inside))
        .join(offsets.drop("lane_size"), ["name", "missing", "lane"])
        .withColumn("reach", F.col("ahead") + F.col("own")),
        "queue",
    )

    def finish(turn) -> Column:
        return (turn * F.col("source_size") + F.col("reach")) / F.col("target")

    def order(turn) -> Column:
        return F.struct(finish(turn).alias("finish"), F.col("rank"), turn.cast("int").alias("turn"), "place",
                        F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"), "size")

    copies = (
        queued.where("size > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"))
        .select("size", "total", order(F.col("turn")).alias("key"))
        .withColumn("tick", F.least(F.floor(F.col("key.finish") * TICKS), F.lit(LAST_TICK)).cast("int"))
    )
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    running = F.sum("words").over(W.orderBy("tick"))  # one row per tick
    ends = (
        ticks.withColumn("until", running)
        .where(F.col("until") > share * F.col("total"))
        .agg(F.min(F.struct("tick", (F.col("until") - F.col("words")).alias("before"))).alias("end"))
        .first()["end"]
    )
    taken = F.lit(repeats)
    if ends is not None:
        own = F.sum("size").over(W.partitionBy("tick").orderBy("key"))
        last = (
            copies.where(F.col("tick") == ends["tick"])
            .withColumn("until", F.lit(ends["before"]) + own)
            .where(F.col("until") <= share * F.col("total"))
            .agg(F.max("key").alias("key"))
            .first()["key"]
        )
        if last is None:  # nothing of that tick fits
            def fits(turn):
                return F.floor(finish(turn) * TICKS) < ends["tick"]
        else:
            bound = F.struct(*[F.lit(last[c]).alias(c) for c in ("finish", "rank", "turn", "place", "doc", "size")])

            def fits(turn):
                return order(turn) <= bound
        taken = sum(F.when(fits(F.lit(t)), 1).otherwise(0) for t in range(repeats))
    return queued.select(
        "doc_id", "place", "name", "missing", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.col("size") * taken).otherwise(0).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``docs``, each as often as ``mixed`` takes it; the columns of ``docs``.

    Joined on key, source and size, so that rows with a repeated id each get their own share.
    """
    names = {n: free_name(docs, n) for n in ("place", "name", "missing", "size", "copies")}
    shares = mixed.where("taken > 0").select(
        *[F.col(n).alias(names[n]) for n in ("place", "name", "missing", "size")],
        (F.col("taken") / F.col("size")).cast("int").alias(names["copies"]),
    ).distinct()
    keyed = docs.withColumns({
        names["place"]: queue_key(F.col("doc_id"), seed),
        names["name"]: F.coalesce("source", F.lit("")),
        names["missing"]: F.col("source").isNull(),
        names["size"]: word_count(F.col("text")),
    })
    joined = keyed.join(materialize(shares, "shares"), [names[n] for n in ("place", "name", "missing", "size")])
    each = free_name(docs, "each")
    return joined.select(
        *docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]))).alias(each)
    ).select(docs.columns)

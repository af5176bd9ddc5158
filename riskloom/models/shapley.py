"""Model-agnostic contributions by sampled Shapley values.

Every sample replaces the features of a row by those of a background row, one after another in
a random order, and books the change of the prediction to the feature just switched. The
predictions are asked for ordinary rows, so any model that can ``transform`` is explained by
one distributed pass. Cost: rows x (1 + samples x (features - 1)) predictions, hence meant for rows
that need an explanation, such as declined applications.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.split import sample_rows
from ..session import materialize, spread

BACKGROUND_ROWS = 500


def background_sample(df: DataFrame, key: str, columns: list[str], n: int = BACKGROUND_ROWS) -> DataFrame:
    """``n`` rows to compare with, all if there are fewer."""
    return sample_rows(df.select(key, *columns), n, key).select(*columns)


def sampled_contributions(
    df: DataFrame,
    key: str,
    columns: list[str],
    background: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    samples: int = 16,
    most_background: int = BACKGROUND_ROWS,
) -> DataFrame:
    """(key, feature, value, contribution) rows.

    ``predict`` adds a ``prob`` column to a frame holding ``columns``. Draws depend on the key
    and the sample number only. A row's contributions add up to its prediction minus the mean
    prediction of the background rows drawn for it. The background is sent to every task: one of
    more than ``most_background`` rows raises.
    """
    background = materialize(background, "background")
    if (found := background.count()) > most_background:
        raise ValueError(f"a background of {found} rows; most_background is {most_background}")
    rows = background.collect()
    if not rows:
        raise ValueError("the background is empty")
    spark, n = df.sparkSession, len(columns)
    names = [f"_b{i}" for i in range(n)]
    listed = [(i, *[float(r[c] or 0.0) for c in columns]) for i, r in enumerate(rows)]
    fields = ", ".join(f"{n} double" for n in names)
    drawn = spark.createDataFrame(listed, f"_row int, {fields}")
    # The first and the last of a sample's predictions are those of two whole rows: each is asked once.
    first = predict(drawn.withColumnsRenamed(dict(zip(names, columns, strict=True)))).select("_row", F.col("prob").alias("_b_prob"))
    drawn = drawn.join(spark.createDataFrame(first.collect(), "_row int, _b_prob double"), "_row")
    whole = predict(spread(df.select(key, *columns))).withColumnRenamed("prob", "_own_prob")

    turns = [F.struct(F.xxhash64(F.col(key), F.col("_sample"), F.lit(i)).alias("turn"), F.lit(i).alias("feature")) for i in range(n)]
    fanned = (
        whole.withColumn("_sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_row", F.pmod(F.xxhash64(F.col(key), F.col("_sample")), F.lit(len(rows))).cast("int"))
        .withColumn("_turns", F.array(*turns))
        .withColumn("_order", F.array_sort("_turns"))
        .join(F.broadcast(drawn), "_row")
        # After so many switches; what one switch leads to the next begins with.
        .withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(max(1, n - 1)))))
    )
    last = F.get("_order", F.col("_step") - 1)
    mixed = [
        F.when(F.get("_turns", F.lit(i))["turn"] <= last["turn"], F.col(c).cast("double")).otherwise(F.col(names[i])).alias(c)
        for i, c in enumerate(columns)
    ]
    own = F.array(*[F.col(c).cast("double") for c in columns])
    asked = fanned.select(
        key, own.alias("_values"), last["feature"].alias("_last"), F.get("_order", F.col("_step"))["feature"].alias("_next"),
        F.when(F.col("_step") == 1, F.col("_b_prob")).alias("_begin"), F.when(F.col("_step") == n - 1, F.col("_own_prob")).alias("_end"),
        *mixed)

    def part(feature: str, change) -> Column:
        return F.struct(F.col(feature).alias("at"), change.alias("change"))

    found = F.array(part("_last", F.col("prob")), part("_next", -F.col("prob")), part("_last", -F.col("_begin")), part("_next", F.col("_end")))
    parts = predict(asked).select(key, "_values", F.inline(found)).where("at is not null and change is not null")
    label = F.get(F.array(*[F.lit(c) for c in columns]), F.col("at"))
    return (
        parts.select(key, label.alias("feature"), F.get("_values", F.col("at")).alias("value"), "change")
        .groupBy(key, "feature")
        .agg(F.first("value").alias("value"), (F.sum("change") / F.lit(float(samples))).alias("contribution"))
    )

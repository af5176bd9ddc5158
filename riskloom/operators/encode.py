"""Learned parts of the feature matrix: vocabularies, state means and medians.

Fitting and applying are separate, so training, batch scoring and streams share one path and
the columns of the matrix never depend on which values a batch happens to hold.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attach, order_statistics, value_steps
from ..session import materialize
from ..sources.schemas import CATEGORICAL_COLUMNS, TARGET_COLUMNS

STATE_PRIOR = 0.08
BRACKET = 0.002  # of the rows, either side of the median
SKETCH_ACCURACY = 10_000
NO_DELINQUENCY = -1.0
NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES and c not in exclude]


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per kept key and feature: ``feature, value``."""
    narrowed = df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns])
    return narrowed.unpivot(keep or [], columns, "feature", "value")


def category_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct non-null values of the categorical columns, as (feature, value) rows."""
    columns = [c for c in (columns or CATEGORICAL_COLUMNS) if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, value string")
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    return values.filter(F.col("value").isNotNull()).distinct()


def state_means(df: DataFrame, label: str, state: str = "state") -> DataFrame:
    """Mean label per state."""
    return (
        df.filter(F.col(state).isNotNull())
        .groupBy(state)
        .agg(F.avg(F.col(label).cast("double")).alias("state_mean"))
    )


def out_of_fold_means(df: DataFrame, label: str, fold: str = "fold", state: str = "state") -> DataFrame:
    """(state, fold, state_mean): mean label of the state's rows outside the fold, null where it has none there.

    Sums of a fold are taken off those of the state, so labels are summed once, whatever the number of folds.
    Null states have no mean; a null label counts in no mean.
    """
    y = F.col(label).cast("double")
    own = (
        df.filter(F.col(state).isNotNull() & F.col(fold).isNotNull())
        .groupBy(state, fold)
        .agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("own"), F.count(y).alias("rows"))
    )
    whole = Window.partitionBy(state)
    others = F.try_divide(F.sum("own").over(whole) - F.col("own"), F.sum("rows").over(whole) - F.col("rows"))
    return own.select(state, fold, others.alias("state_mean"))


def encode_state_out_of_fold(
    df: DataFrame, label: str, fold: str = "fold", fallback: float = STATE_PRIOR, state: str = "state", key: str = "borrower_id"
) -> DataFrame:
    """``state_encoded`` of training rows from the labels of the other folds alone, so no row sees its own label.

    The fallback stands where a state occurs in one fold only or is null. Rows to score take ``encode_state``.
    """
    means = out_of_fold_means(df, label, fold, state)
    return (
        attach(df, means, [state, fold], spread_on=key, how="left")
        .withColumn("state_encoded", F.coalesce(F.col("state_mean"), F.lit(float(fallback))))
        .drop("state_mean", state)
    )


def feature_medians(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Median per feature as (feature, median) rows.

    The approximate form is a single pass with a mergeable sketch per column. The exact one brackets
    each median by such sketches, counts what lies below the bracket and ranks only the
    values inside it: wide aggregates over the table as it is, and few values to order.
    """
    if approximate:
        sketch = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(c) for c in columns])
        return sketch.unpivot([], columns, "feature", "median")
    return _bracketed_medians(df, columns)


def _bracketed_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians; a column whose bracket missed its median is ranked as a whole."""
    spark = df.sparkSession
    numbers = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "numbers")
    shares = F.array(*[F.lit(0.5 + side * BRACKET) for side in (-1, 1)])
    found = numbers.agg(
        *[F.percentile_approx(c, shares, SKETCH_ACCURACY).alias(f"edges_{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
    ).first()
    size = {c: found[f"n_{i}"] for i, c in enumerate(columns)}
    edges = {c: found[f"edges_{i}"] for i, c in enumerate(columns) if size[c]}
    known = list(edges)
    counts = numbers.agg(
        F.lit(0).alias("none"),
        *[F.count_if(F.col(c) < F.lit(edges[c][0])).alias(f"below_{i}") for i, c in enumerate(known)],
        *[F.count_if(F.col(c) <= F.lit(edges[c][1])).alias(f"until_{i}") for i, c in enumerate(known)],
    ).first()
    below = {c: counts[f"below_{i}"] for i, c in enumerate(known)}
    until = {c: counts[f"until_{i}"] for i, c in enumerate(known)}
    held = [c for c in known if below[c] <= (size[c] - 1) // 2 and until[c] > size[c] // 2]
    single = {c: edges[c][0] for c in held if edges[c][0] == edges[c][1]}
    ranked = [c for c in held if c not in single]
    missed = [c for c in known if c not in held]
    rows = list(single.items())  # a column without values has no median
    result = spark.createDataFrame(rows, "feature string, median double")
    if missed:
        result = result.unionByName(
            order_statistics(long_form(numbers, missed), ["feature"], "value", {"median": 0.5}, len(missed)))
    if not ranked:
        return result
    inside = [
        F.struct(F.lit(c).alias("feature"),
                 F.when(F.col(c).between(F.lit(edges[c][0]), F.lit(edges[c][1])), F.col(c)).alias("value"))
        for c in ranked
    ]
    few = numbers.select(F.explode(F.filter(F.array(*inside), lambda x: x["value"].isNotNull())).alias("x"))
    steps = value_steps(few.select("x.*"), ["feature"], "value", {"rows": F.lit(1)}, len(ranked))
    start = F.create_map(*[F.lit(x) for c in ranked for x in (c, below[c])])[F.col("feature")]
    total = F.create_map(*[F.lit(x) for c in ranked for x in (c, size[c])])[F.col("feature")]

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("rows_cum") + start > rank, F.col("value")))

    low, high = at(F.floor((total - 1) / 2)), at(F.ceil((total - 1) / 2))
    pairs = steps.groupBy("feature").agg(low.alias("low"), high.alias("high"))
    return result.unionByName(pairs.select("feature", (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("median")))


def one_hot(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Replace each categorical by 0/1 columns ``<column>_<value>``; null or unseen gives all 0."""
    columns = [c for c in vocabulary if c in df.columns]
    flags = [
        F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
        for c in columns
        for v in vocabulary[c]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def encode_state(
    df: DataFrame,
    means: DataFrame | None,
    fallback: float = STATE_PRIOR,
    state: str = "state",
    key: str = "borrower_id",
) -> DataFrame:
    """``state_encoded``: the state's mean label, or the fallback where it is unknown.

    The lookup has a row per state and one state may hold much of the table, so the join is
    spread over the key.
    """
    if means is None:
        return df.withColumn("state_encoded", F.lit(float(fallback))).drop(state)
    return (
        attach(df, means, [state], spread_on=key, how="left")
        .withColumn("state_encoded", F.coalesce(F.col("state_mean"), F.lit(float(fallback))))
        .drop("state_mean", state)
    )


def flag_delinquency(df: DataFrame) -> DataFrame:
    months = F.col("months_since_last_delinquency")
    return df.withColumn("has_delinquency", months.isNotNull().cast("double")).withColumn(
        "months_since_last_delinquency", F.coalesce(months, F.lit(NO_DELINQUENCY))
    )


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Null becomes the median, else 0; an infinite value becomes 0."""

    def filled(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(float(medians.get(name) or 0.0)))
        return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0.0)).otherwise(value)

    numeric = set(numeric_columns(df))
    return df.select(*[filled(c).alias(c) if c in numeric and c not in KEYS else F.col(c) for c in df.columns])


KEYS = {"borrower_id", "application_id", *TARGET_COLUMNS}


def align(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The trained columns in trained order; a missing one is 0, extra ones are dropped."""
    return df.select(
        *[c for c in keep if c in df.columns],
        *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns],
    )


@dataclass
class FeatureModel:
    """What fitting learned. Everything but ``means`` has a size set by the column list."""

    vocabulary: dict[str, list[str]]
    medians: dict[str, float]
    columns: list[str]
    means: DataFrame | None = None
    state_fallback: float = STATE_PRIOR

    def transform(self, raw: DataFrame, keep: list[str]) -> DataFrame:
        """The finished columns next to ``keep``, whose first entry is the row key."""
        encoded = one_hot(raw, self.vocabulary)
        if "state" in raw.columns:
            encoded = encode_state(encoded, self.means, self.state_fallback, key=keep[0])
        return align(impute(flag_delinquency(encoded), self.medians), self.columns, keep)

    def save(self, spark: SparkSession, path: str) -> None:
        state = {
            "vocabulary": self.vocabulary,
            "medians": self.medians,
            "columns": self.columns,
            "state_fallback": self.state_fallback,
            "encodes_state": self.means is not None,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").json(f"{path}/settings")
        if self.means is not None:
            self.means.write.mode("overwrite").parquet(f"{path}/state_means")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        state = json.loads(spark.read.schema("state string").json(f"{path}/settings").first()["state"])
        means = spark.read.parquet(f"{path}/state_means") if state.pop("encodes_state") else None
        return cls(means=means, **state)


def fit_features(
    raw: DataFrame, keep: list[str], label: str | None = None, approximate_medians: bool = False,
    max_values: int | None = None,
) -> FeatureModel:
    """Learn vocabularies, state means (when a label column is given) and medians from ``raw``.

    Every category value becomes a column, so all of them come to the driver. With ``max_values``,
    more values than that raise before they do.
    """
    values = category_values(raw)
    if max_values is not None:
        values = materialize(values, "category-values")
        if (found := values.count()) > max_values:
            raise ValueError(f"{found} category values; max_values is {max_values}")
    rows = values.collect()
    vocabulary = {
        c: sorted(r["value"] for r in rows if r["feature"] == c) for c in CATEGORICAL_COLUMNS if c in raw.columns
    }
    means, fallback = None, STATE_PRIOR
    if label is not None and "state" in raw.columns:
        means = materialize(state_means(raw, label), "state-means")  # so that its true size is known
        overall = raw.agg(F.avg(F.col(label).cast("double"))).first()[0]
        fallback = STATE_PRIOR if overall is None else float(overall)
    flagged = flag_delinquency(raw)
    numeric = numeric_columns(flagged, exclude={*keep, *KEYS})
    medians = {r["feature"]: r["median"] for r in feature_medians(flagged, numeric, approximate_medians).collect()}
    one_hots = [f"{c}_{v}" for c, values in vocabulary.items() for v in values]
    encoded = ["state_encoded"] if "state" in raw.columns else []
    base = [c for c in numeric if c != "has_delinquency"]
    columns = [*base, *one_hots, *encoded, "has_delinquency"]
    return FeatureModel(vocabulary, medians, columns, means, fallback)

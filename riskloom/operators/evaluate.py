"""Model metrics over a table of labels and probabilities, one or many models at a time.

``by`` names grouping columns (a model, a batch timestamp); ``groups`` says how many groups
there can be, where that is known, which spares a shuffle. Rank metrics all read
``curve_steps``: distinct probabilities with running counts, computed without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attach, clip, rate_or_zero, value_steps
from ..session import materialize

LOG_MARGIN = 2.220446049250313e-16
DECILES = 10
AUC_GATE = 0.70


def curve_steps(
    df: DataFrame, by: list[str], label: str | None = "label", prob: str = "prob", groups: int | None = None
) -> DataFrame:
    """Distinct probabilities in ascending order with running counts of positives and rows.

    Without a label the rows are counts already: ``pos`` and ``rows`` of a probability.
    """
    counts = {"pos": F.when(F.col(label) == 1, 1).otherwise(0), "rows": F.lit(1)} if label else {c: F.col(c) for c in ("pos", "rows")}
    return value_steps(df, by, prob, counts, groups)


def _negatives(suffix: str) -> Column:
    return F.col(f"rows{suffix}") - F.col(f"pos{suffix}")


def rank_metrics(
    df: DataFrame, by: list[str], label: str | None = "label", prob: str = "prob", groups: int | None = None
) -> DataFrame:
    """AUC (ties by mid-rank), Gini and the KS statistic; null where only one class is present."""
    neg, neg_all = F.col("rows") - F.col("pos"), _negatives("_all")
    positives_above = F.col("pos_all") - F.col("pos_cum") + F.col("pos") / 2
    gap = F.try_divide(F.col("pos_cum"), F.col("pos_all")) - F.try_divide(_negatives("_cum"), neg_all)
    found = (
        curve_steps(df, by, label, prob, groups)
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum(neg * positives_above), F.max("pos_all").cast("double") * F.max(neg_all)).alias(
                "auc_roc"
            ),
            F.max(F.abs(gap)).alias("ks_statistic"),
        )
    )
    return found.select(*by, "auc_roc", (2 * F.col("auc_roc") - 1).alias("gini"), "ks_statistic")


def loss_metrics(df: DataFrame, by: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """Log loss and Brier score in one pass."""
    y = F.col(label).cast("double")
    p = clip(F.col(prob), LOG_MARGIN, 1 - LOG_MARGIN)
    return df.groupBy(*by).agg(
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier_score"),
    )


def roc_points(
    df: DataFrame, by: list[str], label: str = "label", prob: str = "prob", groups: int | None = None
) -> DataFrame:
    """One point per distinct probability: rates of rows at or above the threshold."""
    at_or_above = F.col("pos_all") - F.col("pos_cum") + F.col("pos")
    neg_at_or_above = _negatives("_all") - _negatives("_cum") + _negatives("")
    return curve_steps(df, by, label, prob, groups).select(
        *by,
        F.col(prob).alias("threshold"),
        rate_or_zero(at_or_above, F.col("pos_all")).alias("tpr"),
        rate_or_zero(neg_at_or_above, _negatives("_all")).alias("fpr"),
    )


def best_threshold(
    df: DataFrame, by: list[str], label: str = "label", prob: str = "prob", groups: int | None = None
) -> DataFrame:
    """The threshold with the largest tpr - fpr; of equal ones the highest.

    Differences are compared as whole numbers (tp * N - fp * P), so equal ones are equal. The
    curve starts above every score with difference 0, hence an all-negative one yields +inf.
    """
    tp = F.col("pos_all") - F.col("pos_cum") + F.col("pos")
    fp = _negatives("_all") - _negatives("_cum") + _negatives("")
    whole = "decimal(38,0)"
    gain = tp.cast("decimal(19,0)") * _negatives("_all").cast("decimal(18,0)") - fp.cast("decimal(19,0)") * F.col(
        "pos_all"
    ).cast("decimal(18,0)")
    points = curve_steps(df, by, label, prob, groups).select(
        *by, F.struct(gain.cast(whole).alias("gain"), F.col(prob).alias("threshold")).alias("point")
    )
    best = points.groupBy(*by).agg(F.max("point").alias("best"))
    chosen = F.when(F.col("best.gain") > 0, F.col("best.threshold")).otherwise(F.lit(float("inf")))
    return best.select(*by, chosen.alias("optimal_threshold"))


def with_predictions(
    df: DataFrame,
    by: list[str],
    label: str = "label",
    prob: str = "prob",
    threshold: float | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Add ``pred``: 1 at or above the threshold, which defaults to each group's best one."""
    if threshold is not None:
        return df.withColumn("pred", (F.col(prob) >= threshold).cast("int"))
    best = best_threshold(df, by, label, prob, groups)
    joined = attach(df, best, by, spread_on=prob, groups=groups)
    return joined.withColumn("pred", (F.col(prob) >= F.col("optimal_threshold")).cast("int")).drop(
        "optimal_threshold"
    )


def confusion(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )


def classification_report(cells: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def per_class(right: Column, predicted: Column, actual: Column):
        precision, recall = rate_or_zero(right, predicted), rate_or_zero(right, actual)
        f1 = rate_or_zero(2 * right, predicted + actual)
        return precision, recall, f1, actual

    zero, one = per_class(tn, tn + fn, tn + fp), per_class(tp, tp + fp, tp + fn)
    rows = tn + fp + fn + tp

    def entry(name: str, values) -> Column:
        parts = zip(("precision", "recall", "f1", "support"), values, strict=True)
        return F.struct(F.lit(name).alias("class"), *[v.alias(n) for n, v in parts])

    accuracy = rate_or_zero(tn + tp, rows)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3], strict=True)]
    weighted = [
        rate_or_zero(a * zero[3] + b * one[3], rows) for a, b in zip(zero[:3], one[:3], strict=True)
    ]
    entries = F.array(
        entry("0", zero),
        entry("1", one),
        entry("accuracy", (accuracy, accuracy, accuracy, rows)),
        entry("macro avg", (*macro, rows)),
        entry("weighted avg", (*weighted, rows)),
    )
    return cells.select(*by, F.inline(entries))


def decile_table(
    df: DataFrame,
    by: list[str],
    label: str = "label",
    prob: str = "prob",
    bins: int = DECILES,
    groups: int | None = None,
) -> DataFrame:
    """Rows binned at interpolated quantile edges, right-closed; equal edges are merged.

    Edges come from the running counts, so equal probabilities stay in one bin.
    """
    steps = materialize(curve_steps(df, by, label, prob, groups), "decile-steps")
    whole = F.max("rows_all").alias("_n")
    fewer = F.least(F.lit(bins), F.col("rows_all"))
    cuts = []
    for k in range(bins + 1):
        position = (F.col("rows_all") - 1) * F.least(F.lit(1.0), F.lit(k) / fewer)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            cuts.append(F.min(F.when(F.col("rows_cum") > rank, F.col(prob))).alias(f"_{side}{k}"))
    found = steps.groupBy(*by).agg(whole, *cuts)

    def edge(k: int) -> Column:
        position = (F.col("_n") - 1) * F.least(F.lit(1.0), F.lit(k) / F.least(F.lit(bins), F.col("_n")))
        low, high = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        return low + (high - low) * (position - F.floor(position))

    edges = found.select(*by, F.array_distinct(F.array(*[edge(k) for k in range(bins + 1)])).alias("_edges"))
    placed = attach(steps, edges, by, spread_on=prob, groups=groups)
    under = F.size(F.filter("_edges", lambda e: e < F.col(prob)))
    return (
        placed.withColumn("decile", F.greatest(F.lit(1), under))
        .groupBy(*by, "decile")
        .agg(
            F.sum("rows").alias("count"),
            F.sum("pos").alias("default_count"),
            (F.sum("pos") / F.sum("rows")).alias("default_rate"),
            (F.sum(F.col(prob) * F.col("rows")) / F.sum("rows")).alias("avg_predicted_pd"),
            F.min(prob).alias("min_pd"),
            F.max(prob).alias("max_pd"),
        )
    )


def _error_moments(actual: Column, predicted: Column) -> dict[str, Column]:
    error = actual - predicted
    return {
        "mae": F.coalesce(F.avg(F.abs(error)), F.lit(0.0)),
        "rmse": F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)),
    }


def lgd_errors(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 over rows with a positive loss; zeros where there are none."""
    mine = F.col(actual) > 0
    y, p = F.when(mine, F.col(actual)), F.when(mine, F.col(predicted))
    squares = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(F.count(y) > 1, F.coalesce(1 - F.try_divide(squares, spread), F.lit(0.0))).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _error_moments(y, p).items()], r2.alias("r2"))


def ead_errors(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and MAPE over rows with a positive exposure; zeros where there are none."""
    mine = F.col(actual) > 0
    y, p = F.when(mine, F.col(actual)), F.when(mine, F.col(predicted))
    mape = F.coalesce(F.avg(F.abs(y - p) / F.greatest(y, F.lit(1.0))), F.lit(0.0))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _error_moments(y, p).items()], mape.alias("mape"))


def models_long(df: DataFrame, models: list[str], label: str, keep: list[str] | None = None) -> DataFrame:
    """Unpivot one probability column per model into (label, model, prob)."""
    narrowed = df.select(*(keep or []), F.col(label).alias("label"), *models)
    return narrowed.unpivot([*(keep or []), "label"], models, "model", "prob")


def evaluate_pd(
    df: DataFrame, by: list[str], label: str = "label", prob: str = "prob", groups: int | None = None
) -> DataFrame:
    """One row per group: AUC, Gini, KS, log loss, Brier, best threshold and the confusion cells."""
    return metrics_of_steps(curve_steps(df, by, label, prob, groups), by, prob)


def metrics_of_steps(steps: DataFrame, by: list[str], prob: str = "prob") -> DataFrame:
    """All metrics of ``evaluate_pd`` from running counts per distinct probability.

    The best threshold and the cells at it come from the same steps as the rank metrics.
    """
    neg, neg_all = F.col("rows") - F.col("pos"), _negatives("_all")
    tp = F.col("pos_all") - F.col("pos_cum") + F.col("pos")
    fp = neg_all - _negatives("_cum") + neg
    gain = tp.cast("decimal(19,0)") * neg_all.cast("decimal(18,0)") - fp.cast("decimal(19,0)") * F.col(
        "pos_all"
    ).cast("decimal(18,0)")
    p = clip(F.col(prob), LOG_MARGIN, 1 - LOG_MARGIN)
    gap = F.try_divide(F.col("pos_cum"), F.col("pos_all")) - F.try_divide(_negatives("_cum"), neg_all)
    point = F.struct(
        gain.cast("decimal(38,0)").alias("gain"), F.col(prob).alias("threshold"), tp.alias("tp"), fp.alias("fp")
    )
    found = steps.groupBy(*by).agg(
        F.sum(neg * (F.col("pos_all") - F.col("pos_cum") + F.col("pos") / 2)).alias("_area"),
        F.max(F.abs(gap)).alias("ks_statistic"),
        (F.sum(-(F.col("pos") * F.ln(p) + neg * F.ln(1 - p))) / F.sum("rows")).alias("log_loss"),
        (
            F.sum(F.col("pos") * (F.col(prob) - 1) * (F.col(prob) - 1) + neg * F.col(prob) * F.col(prob))
            / F.sum("rows")
        ).alias("brier_score"),
        F.max(point).alias("_best"),
        F.max("pos_all").alias("positives"),
        F.max(neg_all).alias("negatives"),
    )
    auc = F.try_divide(F.col("_area"), F.col("positives").cast("double") * F.col("negatives"))
    crossed = F.col("_best.gain") > 0
    true_pos = F.when(crossed, F.col("_best.tp")).otherwise(F.lit(0))
    false_pos = F.when(crossed, F.col("_best.fp")).otherwise(F.lit(0))
    return found.select(
        *by,
        auc.alias("auc_roc"),
        (2 * auc - 1).alias("gini"),
        "ks_statistic",
        "log_loss",
        "brier_score",
        F.when(crossed, F.col("_best.threshold")).otherwise(F.lit(float("inf"))).alias("optimal_threshold"),
        (F.col("negatives") - false_pos).alias("tn"),
        false_pos.alias("fp"),
        (F.col("positives") - true_pos).alias("fn"),
        true_pos.alias("tp"),
    )


def performance_gate(metrics: DataFrame, threshold: float = AUC_GATE) -> DataFrame:
    return metrics.withColumn("passed", F.coalesce(F.col("auc_roc") >= threshold, F.lit(False)))

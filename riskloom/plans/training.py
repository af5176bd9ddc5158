"""The training job, from the three input tables to saved models and test metrics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import ensemble
from ..models.estimators import (
    Classifier,
    ExposureModel,
    TwoStageLGD,
    fit_exposure,
    fit_fraud,
    fit_pd,
    fit_two_stage_lgd,
)
from ..models.shapley import background_sample
from ..models.side_by_side import side_by_side, training_table
from ..models.tuning import tune_boosted, with_temperature
from ..operators import evaluate, quality
from ..operators.assemble import raw_features, require_labels
from ..operators.encode import FeatureModel, fit_features
from ..operators.profile import conversion_label
from ..operators.split import split_summary, stratified_split
from ..operators.transactions import DEFAULT_REFERENCE_DATE
from ..session import materialize
from ..sources.schemas import TARGET_COLUMNS

WEIGHT_STEPS = ensemble.GRID_STEPS
CARRIED = ["current_credit_balance", "total_credit_limit"]
PD_KINDS = ("logistic", "boosted", "boosted_balanced")


@dataclass
class TrainingRun:
    """What a run leaves behind."""

    features: FeatureModel
    matrix: DataFrame
    pd_models: dict[str, Classifier]
    weights: dict[str, float]
    lgd: TwoStageLGD
    ead: ExposureModel
    fraud: Classifier
    checks: DataFrame
    splits: DataFrame
    pd_metrics: DataFrame
    lgd_metrics: DataFrame
    ead_metrics: DataFrame
    background: DataFrame
    columns: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        spark = self.matrix.sparkSession
        self.features.save(spark, f"{path}/features")
        for name, model in self.pd_models.items():
            model.save(f"{path}/pd_{name}")
        self.lgd.save(f"{path}/lgd")
        if self.ead.conversion is not None:
            self.ead.conversion.save(f"{path}/ead")
        self.fraud.save(f"{path}/fraud")
        ensemble.save_weights(spark, self.weights, f"{path}/weights")
        self.background.write.mode("overwrite").parquet(f"{path}/background")
        # Written last: a run without it was not saved to the end.
        manifest = {
            "pd_models": list(self.pd_models),
            "severity": self.lgd.severity is not None,
            "conversion": self.ead.conversion is not None,
            "columns": self.columns,
        }
        rows = spark.createDataFrame([(json.dumps(manifest),)], "manifest string")
        rows.write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """What a saved run holds; folders it doesn't name are left from another run."""
    return json.loads(spark.read.schema("manifest string").json(f"{path}/manifest").first()["manifest"])


def predictions(df: DataFrame, models: dict[str, Classifier]) -> DataFrame:
    """One probability column per model next to the input columns."""
    for name, model in models.items():
        df = model.predict(df, name)
    return df


def train(
    borrowers: DataFrame,
    transactions: DataFrame,
    payments: DataFrame,
    reference_date=DEFAULT_REFERENCE_DATE,
    key: str = "borrower_id",
    kinds: tuple[str, ...] = PD_KINDS,
    params: dict[str, dict] | None = None,
    search: list[dict] | None = None,
    steps: int = WEIGHT_STEPS,
    parallelism: int | None = None,
) -> TrainingRun:
    """Validate, build features, split, fit, weigh and evaluate.

    The models don't depend on each other and are fitted side by side, ``parallelism`` at once (default: one per core).

    Raw features are written once and re-read by every later step. Vocabularies, state means
    and medians are learned from the training part alone, so the test part stays unseen.
    """
    params = dict(params or {})
    checks = quality.validate_borrowers(borrowers, key=key)
    keep = [*TARGET_COLUMNS, *CARRIED]
    raw = materialize(raw_features(borrowers, transactions, payments, reference_date, key, keep), "raw-features")
    require_labels(raw, borrowers, key)
    split = materialize(stratified_split(raw, "is_default", key), "split-features")
    held = [key, "split", *keep]
    features = fit_features(split.filter("split = 'train'").drop("split"), [key, *keep], "is_default")
    matrix = materialize(features.transform(split, held), "matrix")
    columns = features.columns
    part = {name: matrix.filter(F.col("split") == name) for name in ("train", "validation", "test")}

    if search is not None:
        params["boosted"] = {**params.get("boosted", {}), **tune_boosted(part["train"], columns, "is_default", search, key, parallelism)}
    factor = conversion_label(F.col("ead_value"), F.col(CARRIED[0]), F.col(CARRIED[1]))
    table = training_table(part["train"].withColumn("_conversion", factor).drop("split"))
    fits = {
        **{f"pd_{k}": partial(fit_pd, k, table, columns, "is_default", **params.get(k, {})) for k in kinds},
        "lgd": partial(fit_two_stage_lgd, table, columns, "lgd_value", **params.get("lgd", {})),
        "ead": partial(fit_exposure, table, columns, "_conversion", **params.get("ead", {})),
        "fraud": partial(fit_fraud, table, columns, "is_fraud", **params.get("fraud", {})),
    }
    # The longest fits begin first.
    fitted = side_by_side(raw.sparkSession, {name: fits[name] for name in sorted(fits, key=lambda n: n != "fraud")}, parallelism)
    table.unpersist()
    pd_models = {k: fitted[f"pd_{k}"] for k in kinds}
    lgd, ead, fraud = fitted["lgd"], fitted["ead"], fitted["fraud"]
    validated = materialize(predictions(part["validation"], pd_models).select("is_default", *kinds), "validation")
    weights = ensemble.search_weights(validated, list(kinds), "is_default", steps=steps)

    tested = predictions(part["test"], pd_models).withColumn("ensemble", ensemble.combine(weights))
    tested = ead.predict(lgd.predict(tested, "lgd"), CARRIED[0], CARRIED[1], "ead")
    tested = materialize(tested.select(*TARGET_COLUMNS, *kinds, "ensemble", "lgd", "ead"), "test-scores")
    long = evaluate.models_long(tested, [*kinds, "ensemble"], "is_default")
    return TrainingRun(
        features=features,
        matrix=matrix,
        pd_models=pd_models,
        weights=weights,
        lgd=lgd,
        ead=ead,
        fraud=fraud,
        checks=checks,
        splits=split_summary(matrix, "is_default"),
        pd_metrics=evaluate.performance_gate(evaluate.evaluate_pd(long, ["model"], groups=len(kinds) + 1)),
        lgd_metrics=evaluate.lgd_errors(tested, [], "lgd_value", "lgd"),
        ead_metrics=evaluate.ead_errors(tested, [], "ead_value", "ead"),
        background=background_sample(part["train"], key, columns),
        columns=columns,
    )


def add_challenger(run: TrainingRun, kind: str = "crosses", steps: int = WEIGHT_STEPS, **params) -> TrainingRun:
    """Fit one more model on the same split, calibrate it on the validation part, re-weigh and re-evaluate."""
    part = {name: run.matrix.filter(F.col("split") == name) for name in ("train", "validation", "test")}
    model = with_temperature(fit_pd(kind, part["train"], run.columns, "is_default", **params), part["validation"], "is_default")
    models = {**run.pd_models, kind: model}
    names = list(models)
    validated = materialize(predictions(part["validation"], models).select("is_default", *names), "validation")
    weights = ensemble.search_weights(validated, names, "is_default", steps=steps)
    tested = predictions(part["test"], models).withColumn("ensemble", ensemble.combine(weights))
    tested = materialize(tested.select("is_default", *names, "ensemble"), "test-scores")
    long = evaluate.models_long(tested, [*names, "ensemble"], "is_default")
    metrics = evaluate.performance_gate(evaluate.evaluate_pd(long, ["model"], groups=len(names) + 1))
    return TrainingRun(**{**run.__dict__, "pd_models": models, "weights": weights, "pd_metrics": metrics})


def reevaluate(path: str, matrix: DataFrame, kinds: list[str], part: str = "test") -> DataFrame:
    """Metrics of saved models on a part of the matrix."""
    models = {k: Classifier.load(f"{path}/pd_{k}") for k in kinds}
    weights = ensemble.load_weights(matrix.sparkSession, f"{path}/weights", kinds)
    scored = predictions(matrix.filter(F.col("split") == part), models)
    scored = scored.withColumn("ensemble", ensemble.combine(weights)).select("is_default", *kinds, "ensemble")
    long = evaluate.models_long(scored, [*kinds, "ensemble"], "is_default")
    return evaluate.performance_gate(evaluate.evaluate_pd(long, ["model"], groups=len(kinds) + 1))

"""Estimators for default, loss, exposure and fraud, built on ``pyspark.ml``.

Fitting runs as Spark jobs over the distributed training table; fitted models are
``PipelineModel``s, so scoring is a lazy ``transform`` and saving uses Spark's own format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clip
from ..operators.decision import REGULATORY_CONVERSION, exposure
from ..operators.split import class_weights
from .boosting import BoostedTrees
from .calibration import calibrated
from .crosses import WeightedMachine
from .tree_scores import margin

WEIGHT = "_weight"
MIN_SEVERITY_ROWS = 10


def weight_column(df: DataFrame, label: str, kind: str = "balanced_weight") -> Column:
    """Class weights as a column expression: two numbers are learned, no join is needed."""
    weights = {r[label]: r[kind] for r in class_weights(df, label).collect()}
    return F.when(F.col(label) == 1, F.lit(weights.get(1, 1.0))).otherwise(F.lit(weights.get(0, 1.0)))


def _assembler(columns: list[str], output: str = "_features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep")


def _scaled(columns: list[str]) -> list:
    return [
        _assembler(columns, "_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
    ]


@dataclass
class Classifier:
    """A fitted probability model; ``predict`` adds one column and nothing else.

    ``temperature``, where set, is applied to every probability.
    """

    model: PipelineModel
    temperature: float | None = None

    def predict(self, df: DataFrame, name: str = "pd") -> DataFrame:
        scored, grown = df, margin(df, self.model)
        if grown is None:
            scored, prob = self.model.transform(df), vector_to_array("_probability")[1]
        else:
            prob = 1 - 1 / (1 + F.exp(2 * grown))
        prob = prob if self.temperature is None else calibrated(prob, self.temperature)
        return scored.select(*df.columns, prob.alias(name))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        settings = SparkSession.active().createDataFrame([(self.temperature,)], "temperature double")
        settings.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/calibration")

    @classmethod
    def load(cls, path: str) -> Classifier:
        settings = SparkSession.active().read.schema("temperature double").json(f"{path}/calibration").first()
        return cls(PipelineModel.load(f"{path}/model"), settings["temperature"])


def fit_logistic(
    df: DataFrame, columns: list[str], label: str, c: float = 1.0, max_iter: int = 1000, balanced: bool = True
) -> Classifier:
    """L2-penalised logistic regression on scaled features.

    The penalty 1/(C * summed weight) makes C mean what it means for a summed loss.
    """
    weighted = df.withColumn(WEIGHT, weight_column(df, label) if balanced else F.lit(1.0))
    total = weighted.agg(F.sum(WEIGHT)).first()[0] or 1.0
    estimator = LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        weightCol=WEIGHT,
        probabilityCol="_probability",
        rawPredictionCol="_margin",
        predictionCol="_class",
        regParam=1.0 / (c * total),
        elasticNetParam=0.0,
        maxIter=max_iter,
        standardization=False,
    )
    return Classifier(Pipeline(stages=[*_scaled(columns), estimator]).fit(weighted))


def boosted_classifier(columns: list[str], label: str, weighted: bool, **params) -> Pipeline:
    settings = {
        "maxIter": 300,
        "maxDepth": 6,
        "stepSize": 0.1,
        "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
        "seed": 42,
        **params,
    }
    if weighted:
        settings["weightCol"] = WEIGHT
    trees = GBTClassifier(featuresCol="_features", labelCol=label, predictionCol="_class", **settings)
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    return Pipeline(stages=[_assembler(columns), BoostedTrees(trees, len(columns))])


def fit_boosted(df: DataFrame, columns: list[str], label: str, **params) -> Classifier:
    return Classifier(boosted_classifier(columns, label, False, **params).fit(df))


def fit_boosted_balanced(df: DataFrame, columns: list[str], label: str, **params) -> Classifier:
    weighted = df.withColumn(WEIGHT, weight_column(df, label))
    return Classifier(boosted_classifier(columns, label, True, **params).fit(weighted))


def fit_crosses(
    df: DataFrame, columns: list[str], label: str, factors: int = 8, max_iter: int = 100, step: float = 0.05,
    weighted: bool = True,
) -> Classifier:
    """The challenger: a factorisation machine, i.e. linear terms plus learned feature crosses.

    A positive row counts as often as the capped positive weight says.
    """
    times = F.lit(1)
    if weighted:
        weights = {r[label]: r["capped_weight"] for r in class_weights(df, label).collect()}
        times = F.when(F.col(label) == 1, max(1, round(weights.get(1, 1.0)))).otherwise(1)
    df = df.withColumn(WEIGHT, times)
    machine = FMClassifier(
        featuresCol="_features",
        labelCol=label,
        probabilityCol="_probability",
        rawPredictionCol="_margin",
        predictionCol="_class",
        factorSize=factors,
        maxIter=max_iter,
        stepSize=step,
        seed=42,
    )
    # The scaler knows no weights and is learned in one pass over the repeated rows; the steps count each row once.
    scaler = Pipeline(stages=_scaled(columns)).fit(df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(WEIGHT)))))
    fitted = WeightedMachine(machine, len(columns), WEIGHT).fit(scaler.transform(df))
    return Classifier(PipelineModel(stages=[*scaler.stages, fitted]))


def cross_embeddings(model: Classifier, df: DataFrame, name: str = "embedding") -> DataFrame:
    """The row's position in the factor space of the challenger, an array per row."""
    *prepare, machine = model.model.stages
    factors = machine.factors.toArray()
    prepared = df
    for stage in prepare:
        prepared = stage.transform(prepared)
    values = vector_to_array("_features")

    def coordinate(k: int) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in factors[:, k]])
        return F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)

    return prepared.select(*df.columns, F.array(*[coordinate(k) for k in range(factors.shape[1])]).alias(name))


PD_MODELS = {
    "logistic": fit_logistic,
    "boosted": fit_boosted,
    "boosted_balanced": fit_boosted_balanced,
    "crosses": fit_crosses,
}


def fit_pd(kind: str, df: DataFrame, columns: list[str], label: str, **params) -> Classifier:
    if kind not in PD_MODELS:
        raise ValueError(f"unknown model {kind}; known: {', '.join(PD_MODELS)}")
    return PD_MODELS[kind](df, columns, label, **params)


def fit_fraud(df: DataFrame, columns: list[str], label: str, **params) -> Classifier:
    return fit_boosted_balanced(df, columns, label, **{"maxIter": 500, "maxDepth": 8, "stepSize": 0.05, **params})


def boosted_regressor(columns: list[str], target: str, **params) -> Pipeline:
    settings = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "seed": 42, **params}
    trees = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="_value", **settings)
    return Pipeline(stages=[_assembler(columns), BoostedTrees(trees, len(columns))])


@dataclass
class Regressor:
    """A fitted regression clipped to [0, 1]."""

    model: PipelineModel

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        return self.unclipped(df).select(*df.columns, clip(F.col("_value"), 0.0, 1.0).alias(name))

    def unclipped(self, df: DataFrame) -> DataFrame:
        grown = margin(df, self.model)
        return self.model.transform(df) if grown is None else df.withColumn("_value", grown)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Regressor:
        return cls(PipelineModel.load(path))


def fit_direct_lgd(df: DataFrame, columns: list[str], target: str, **params) -> Regressor:
    return Regressor(boosted_regressor(columns, target, **params).fit(df))


@dataclass
class TwoStageLGD:
    """Chance of a loss times its expected size, clipped to [0, 1]."""

    chance: Classifier
    severity: Regressor | None

    def predict(self, df: DataFrame, name: str = "lgd") -> DataFrame:
        scored = self.chance.predict(df, "_chance")
        if self.severity is None:
            return scored.withColumn(name, F.lit(0.0)).drop("_chance")
        sized = self.severity.unclipped(scored)
        return sized.select(*df.columns, clip(F.col("_chance") * F.col("_value"), 0.0, 1.0).alias(name))

    def save(self, path: str) -> None:
        self.chance.save(f"{path}/chance")
        if self.severity is not None:
            self.severity.save(f"{path}/severity")

    @classmethod
    def load(cls, path: str, with_severity: bool = True) -> TwoStageLGD:
        return cls(
            Classifier.load(f"{path}/chance"), Regressor.load(f"{path}/severity") if with_severity else None
        )


def fit_two_stage_lgd(df: DataFrame, columns: list[str], target: str, **params) -> TwoStageLGD:
    """Severity is learned from rows with a loss, given more than ten of them."""
    labelled = df.withColumn("_loss", (F.col(target) > 0).cast("int"))
    chance = fit_logistic(labelled, columns, "_loss")
    losses = df.filter(F.col(target) > 0)
    enough = losses.limit(MIN_SEVERITY_ROWS + 1).count() > MIN_SEVERITY_ROWS
    severity = Regressor(boosted_regressor(columns, target, **params).fit(losses)) if enough else None
    return TwoStageLGD(chance, severity)


@dataclass
class ExposureModel:
    """Exposure from a learned conversion factor, or the regulatory one where none was learned."""

    conversion: Regressor | None
    regulatory: float = REGULATORY_CONVERSION

    def predict(self, df: DataFrame, drawn: str, limit: str, name: str = "ead") -> DataFrame:
        if self.conversion is None:
            scored = df.withColumn("_factor", F.lit(self.regulatory))
        else:
            scored = self.conversion.predict(df, "_factor")
        return scored.withColumn(name, exposure(F.col("_factor"), F.col(drawn), F.col(limit))).drop("_factor")

    def predict_factor(self, df: DataFrame, name: str = "conversion") -> DataFrame:
        return df.withColumn(name, F.lit(self.regulatory)) if self.conversion is None else self.conversion.predict(df, name)


def fit_exposure(df: DataFrame, columns: list[str], factor: str, **params) -> ExposureModel:
    """Learn the conversion factor from rows where it lies in [0, 1], given more than ten."""
    valid = df.filter(F.col(factor).between(0.0, 1.0) & ~F.isnan(factor))
    if valid.limit(MIN_SEVERITY_ROWS + 1).count() <= MIN_SEVERITY_ROWS:
        return ExposureModel(None)
    trees = {"maxIter": 100, "maxDepth": 3, **params}
    return ExposureModel(Regressor(boosted_regressor(columns, factor, **trees).fit(valid)))

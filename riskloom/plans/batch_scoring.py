"""Applications in, decisions out. The same plan serves a batch job and a stream."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import ensemble
from ..models.estimators import Classifier, ExposureModel, Regressor, TwoStageLGD
from ..models.leaf_paths import tree_contributions
from ..models.shapley import sampled_contributions
from ..operators import explain, quality
from ..operators.decision import score_frame
from ..operators.encode import FeatureModel
from ..operators.profile import borrower_features, with_utilization
from ..session import computed_once, spread
from .training import read_manifest

MODEL_VERSION = "1.0.0"
REASONS = "adverse_action_reasons"


@dataclass
class Scorer:
    """Everything a decision needs, as fitted by a training run."""

    features: FeatureModel
    pd_models: dict[str, Classifier]
    weights: dict[str, float]
    lgd: TwoStageLGD
    ead: ExposureModel
    fraud: Classifier

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        """The scorer of a saved training run, by its path alone.

        Weights are taken for the models at hand and scaled to a sum of one.
        """
        held = read_manifest(spark, path)
        names = held["pd_models"]
        return cls(
            features=FeatureModel.load(spark, f"{path}/features"),
            pd_models={n: Classifier.load(f"{path}/pd_{n}") for n in names},
            weights=ensemble.load_weights(spark, f"{path}/weights", names),
            lgd=TwoStageLGD.load(f"{path}/lgd", held["severity"]),
            ead=ExposureModel(Regressor.load(f"{path}/ead") if held["conversion"] else None),
            fraud=Classifier.load(f"{path}/fraud"),
        )

    def score(self, matrix: DataFrame, keep: list[str], drawn: str | None = None, limit: str | None = None) -> DataFrame:
        """The nine score columns for finished feature rows, which are dealt to all cores."""
        scored = spread(matrix)
        for name, model in self.pd_models.items():
            scored = model.predict(scored, f"_pd_{name}")
        combined = ensemble.combine({f"_pd_{n}": self.weights[n] for n in self.pd_models})
        scored = scored.withColumn("pd", combined)
        scored = self.lgd.predict(scored, "lgd")
        scored = self.ead.predict_factor(scored, "conversion")
        scored = self.fraud.predict(scored, "fraud_score")
        return score_frame(scored, conversion="conversion", drawn=drawn, limit=limit, keep=keep)

    def matrix(self, applications: DataFrame, key: str = "application_id") -> DataFrame:
        carried = ["current_credit_balance", "total_credit_limit"]
        raw = borrower_features(with_utilization(applications), key, carried)
        return self.features.transform(raw, [key, *carried])


def score_applications(
    applications: DataFrame, scorer: Scorer, key: str = "application_id", use_balance: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Decisions for the valid applications, and the quarantined ones with their reasons.

    ``use_balance`` takes drawn and limit from the application instead of the defaults. A small file is one task's, so
    applications are dealt to all cores before they are judged.
    """
    valid, rejected = quality.split_valid(computed_once(spread(applications)), quality.application_rules())
    matrix = scorer.matrix(valid, key)
    drawn, limit = ("current_credit_balance", "total_credit_limit") if use_balance else (None, None)
    return scorer.score(matrix, [key], drawn, limit), rejected


def declined_reasons(
    matrix: DataFrame,
    scored: DataFrame,
    scorer: Scorer,
    background: DataFrame,
    key: str = "application_id",
    samples: int = 8,
    model: str | None = None,
) -> DataFrame:
    """Notices for declined rows only, from the contributions of one model of the ensemble.

    Those of a boosted model are exact, from its leaves; for any other model they are sampled.
    """
    columns = scorer.features.columns
    explained_model = scorer.pd_models[model or max(scorer.weights, key=scorer.weights.get)]
    declined = matrix.join(explain.declined_only(scored.select(key, "decision")).select(key), key, "left_semi")
    if isinstance(explained_model.model.stages[-1], GBTClassificationModel):
        long = tree_contributions(declined, key, columns, background, explained_model.model)
    else:
        long = sampled_contributions(
            declined, key, columns, background, lambda df: explained_model.predict(df, "prob"), samples
        )
    return explain.notice(explain.adverse_reasons(explain.from_long(long, key)), key)


def responses(scored: DataFrame, notices: DataFrame | None = None, key: str = "application_id") -> DataFrame:
    """Reply rows: the decision, its reasons where declined, batch id, version and time.

    Reasons come from ``notices`` or, where the rows were explained before scoring, from the rows themselves.
    """
    out = scored if notices is None else scored.join(notices, key, "left")
    if REASONS not in out.columns:
        out = out.withColumn(REASONS, F.lit(None).cast("array<struct<code:string,reason:string>>"))
    else:
        out = out.withColumn(REASONS, F.when(F.col("decision") == "declined", F.col(REASONS)))
    return out.select(
        key,
        "credit_score",
        "risk_tier",
        F.col("pd").alias("probability_of_default"),
        F.col("lgd").alias("loss_given_default"),
        F.col("ead").alias("exposure_at_default"),
        "expected_loss",
        "fraud_score",
        "fraud_flag",
        "decision",
        REASONS,
        F.lit(str(uuid.uuid4())).alias("batch_id"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.current_timestamp().alias("scored_at"),
    )


def decider(scorer: Scorer, background: DataFrame | None = None, key: str = "application_id", samples: int = 8):
    """The batch function of a service: valid applications to replies, with reasons where a background is given.

    An application that stands twice in a batch is explained once and answered twice.
    """

    def decide(applications: DataFrame) -> DataFrame:
        matrix = scorer.matrix(applications, key)
        scored = scorer.score(matrix, [key])
        if background is None:
            return responses(scored, key=key)
        once = matrix.dropDuplicates([key])
        return responses(scored, declined_reasons(once, scored, scorer, background, key, samples), key)

    return decide


def answer_batch(replies: DataFrame, path: str) -> DataFrame:
    """Write the replies; returns batch id, number processed and the milliseconds it took."""
    started = time.perf_counter()
    replies.write.mode("overwrite").parquet(path)
    spent = round((time.perf_counter() - started) * 1000, 2)
    written = replies.sparkSession.read.parquet(path)
    return batch_summary(written).withColumn("processing_time_ms", F.lit(spent))


def batch_summary(replies: DataFrame) -> DataFrame:
    return replies.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_processed"))

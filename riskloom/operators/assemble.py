"""The feature matrix: one row per borrower from the three input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.schemas import TARGET_COLUMNS
from .encode import FeatureModel, fit_features
from .payments import PAYMENT_FEATURES, payment_features
from .profile import RATIO_FEATURES, borrower_features
from .transactions import DEFAULT_REFERENCE_DATE, TRANSACTION_FEATURES, transaction_features


def raw_features(
    borrowers: DataFrame,
    transactions: DataFrame,
    payments: DataFrame,
    reference_date=DEFAULT_REFERENCE_DATE,
    key: str = "borrower_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Families joined on the borrower, before encoding.

    A borrower absent from a family keeps nulls there (imputed later by the population
    median), while gaps inside a family are already 0. Every family arrives partitioned by
    the borrower, so the joins add no shuffle besides the borrower table's own.
    """
    base = borrower_features(borrowers, key, keep)
    joined = base.join(transaction_features(transactions, reference_date, key), key, "left").join(
        payment_features(payments, key), key, "left"
    )
    own = [c for c in base.columns if c not in RATIO_FEATURES]
    return joined.select(*own, *TRANSACTION_FEATURES, *PAYMENT_FEATURES, *RATIO_FEATURES)


def feature_matrix(
    borrowers: DataFrame,
    transactions: DataFrame,
    payments: DataFrame,
    reference_date=DEFAULT_REFERENCE_DATE,
    key: str = "borrower_id",
    model: FeatureModel | None = None,
    label: str | None = None,
    keep: list[str] | None = None,
) -> tuple[DataFrame, FeatureModel]:
    """The finished matrix and the model that made it; pass ``model`` to reuse a fitted one.

    Fitting reads the joined families several times, so they are written once to the shared
    folder first: the histories are scanned once however many statistics are learned.
    """
    kept = [key, *(keep or [])]
    needed = list(dict.fromkeys([*(keep or []), *([label] if label else [])]))
    raw = raw_features(borrowers, transactions, payments, reference_date, key, needed)
    if model is None:
        raw = materialize(raw, "raw-features")
        model = fit_features(raw, [key, *needed], label)
    return model.transform(raw, kept), model


def with_labels(features: DataFrame, borrowers: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Attach the target columns by key."""
    targets = [c for c in TARGET_COLUMNS if c in borrowers.columns and c not in features.columns]
    return features.join(borrowers.select(key, *targets), key)


def require_labels(features: DataFrame, borrowers: DataFrame, key: str = "borrower_id") -> None:
    """Raise when a feature row has no borrower row to take its label from."""
    lost = features.join(borrowers.select(key), key, "left_anti").limit(1).count()
    if lost:
        raise KeyError(f"feature rows without a borrower, matched on {key}")


def drop_targets(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in TARGET_COLUMNS if c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    """Null, NaN and infinite numbers become 0."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "double":
            bad = F.isnan(name) | (F.abs(name) == F.lit(float("inf"))) | F.col(name).isNull()
            columns.append(F.when(bad, F.lit(0.0)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)

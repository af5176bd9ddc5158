"""Temperature scaling of probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import clip

MARGIN = 1e-7


def logit(prob: Column) -> Column:
    bounded = clip(prob, MARGIN, 1 - MARGIN)
    return F.ln(bounded / (1 - bounded))


def calibrated(prob: Column, temperature) -> Column:
    """The probability with its log-odds divided by the temperature."""
    divisor = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return 1 / (1 + F.exp(-logit(prob) / divisor))

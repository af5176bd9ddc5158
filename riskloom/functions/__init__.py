from .attach import attach
from .numeric import clip, finite, known, rate_or_zero, ratio_floor, total
from .ordering import order_statistics, rank_within, value_steps
from .timeparts import cutoff, month_start, timestamp_literal

__all__ = [
    "attach",
    "clip",
    "cutoff",
    "finite",
    "known",
    "month_start",
    "order_statistics",
    "rank_within",
    "rate_or_zero",
    "ratio_floor",
    "timestamp_literal",
    "total",
    "value_steps",
]

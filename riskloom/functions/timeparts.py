"""Time helpers that keep the column's own timestamp type, so filters still push down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_datetime(moment) -> dt.datetime:
    if isinstance(moment, dt.datetime):
        return moment
    if isinstance(moment, dt.date):
        return dt.datetime(moment.year, moment.month, moment.day)
    return dt.datetime.fromisoformat(str(moment))


def timestamp_literal(df: DataFrame, column: str, moment) -> Column:
    """``moment`` in the type of ``column``: comparing equal types avoids a cast on the scan side."""
    text = _as_datetime(moment).isoformat(sep=" ")
    return F.lit(text).cast(df.schema[column].dataType)


def cutoff(df: DataFrame, column: str, reference_date, days: int) -> Column:
    """The start of a window of ``days`` ending at ``reference_date``."""
    return timestamp_literal(df, column, _as_datetime(reference_date) - dt.timedelta(days=days))


def month_start(column: Column) -> Column:
    """First day of the month, taken through a date so that no time zone is involved."""
    return F.trunc(column.cast("date"), "MM")

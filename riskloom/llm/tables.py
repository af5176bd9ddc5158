"""Helpers the text operators share: free column names, written tables, raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.session import materialize

# What separates words: the six ASCII white-space characters, as ``bytes.split`` has them.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def word_count(text):
    """Number of words of a text column, null counting as no text.

    Every word becomes one letter, then all else goes: no array of words is built, so a very
    long text costs no more than its own length.
    """
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def keep_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids`` (each id once), one row for a repeated key.

    Texts move once, in the semi join. Keys that occur more than once are found on the key column
    alone; only their rows are brought together, and the first text in order stays.
    """
    again = materialize(
        docs.groupBy(key).count().where("count > 1 and " + key + " is not null").select(key), "repeated-ids"
    )
    ids, name = ids.select(key), free_name(docs, "nth")
    single = docs.join(again, key, "left_anti").join(ids, key, "left_semi").select(docs.columns)
    nth = F.row_number().over(W.partitionBy(key).orderBy("text"))
    repeated = (
        docs.join(again, key, "left_semi").join(ids, key, "left_semi").withColumn(name, nth)
        .where(F.col(name) == 1).select(docs.columns)
    )
    return single.unionByName(repeated)


def write_raw(rows: DataFrame, column: str, path: str, separator: str, per_file: int = 0) -> None:
    """Write a binary column as raw bytes, ``separator`` after each row, to any Spark file system.

    The text writer copies a string's bytes unchanged and commits each task's files once, so
    retried or speculative tasks leave nothing behind. Spark's binary-to-string cast keeps bytes.
    """
    writer = rows.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.option("compression", "none").text(path)

"""Language of a text by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = "und"
CHUNK = 1 << 18  # characters held as n-grams at once
LETTER = "\\p{L}"


def codewords(classes: int, least_bits: int = 7) -> np.ndarray:
    """One row of +1/-1 per class.

    Up to five classes get the exhaustive code: every split of the classes once, so any two words
    differ in half of the bits or more. Beyond that, rows of a Walsh-Hadamard matrix without its
    constant column: any two differ in half of their bits.
    """
    if classes <= 5:
        splits = np.arange(1, 2 ** max(1, classes - 1), dtype=np.int64)
        word = np.where((splits[None, :] >> np.arange(max(classes - 1, 1))[:, None]) & 1, 1, -1)
        return np.vstack([-np.ones((1, word.shape[1]), np.int64), word])[:classes]
    size = 1 << max(int(np.ceil(np.log2(classes + 1))), int(np.ceil(np.log2(least_bits + 1))))
    rows, columns = np.arange(classes)[:, None], np.arange(1, size)[None, :]
    return 1 - 2 * (np.bitwise_count(rows & columns).astype(np.int64) & 1)


def _buckets(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for n of 1 to 3.

    Those that start in the overlap of a piece are left to the next one.
    """
    mixed = codes.astype(np.uint64) + np.uint64(1)
    gram = np.zeros(len(mixed), np.uint64)
    for n in range(3):
        gram = gram[: len(mixed) - n] * np.uint64(0x9E3779B97F4A7C15) + mixed[n:]
        spread = gram ^ (gram >> np.uint64(29))
        yield ((spread[:CHUNK] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64) % size


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text in pieces of bounded size, two points of overlap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # Digits, marks and all white space look alike: they say little about the language.
    codes = np.where((codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 170)), 32, codes)
    for at in range(0, len(codes), CHUNK):
        yield codes[at : at + CHUNK + 2]


@dataclass(frozen=True)
class CodeModel:
    """Weights of the bit classifiers and the codewords they are decoded with."""

    languages: tuple[str, ...]
    words: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits, log odds of an n-gram
    trust: np.ndarray  # weight of each bit's loss
    sharpness: float

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds of each bit over all n-grams of the whole text."""
        total, count = np.zeros(self.words.shape[1]), 0
        for codes in _pieces(text):
            for bucket in _buckets(codes, len(self.weights)):
                total += np.bincount(bucket, minlength=len(self.weights)) @ self.weights
                count += len(bucket)
        return total / max(count, 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score from 0 to 1, and the lead over the next.

        The loss of a codeword is the logistic loss of every bit's margin against it, weighted
        by the trust in the bit.
        """
        agreement = self.sharpness * margins[:, None, :] * self.words[None, :, :]
        loss = (np.logaddexp(0.0, -agreement) * self.trust).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        ranked = np.sort(share, axis=1)
        lead = ranked[:, -1] - ranked[:, -2] if share.shape[1] > 1 else ranked[:, -1]
        return loss.argmin(axis=1), ranked[:, -1], lead


def _counts(rows: DataFrame, languages: list[str], size: int) -> np.ndarray:
    """N-gram counts, languages x buckets, summed over the rows by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(languages), size), np.int64)
        for frame in frames:
            for text, language in zip(frame["text"], frame["lang"], strict=True):
                for codes in _pieces(text):
                    for bucket in _buckets(codes, size):
                        table[languages.index(language)] += np.bincount(bucket, minlength=size)
        language, bucket = np.nonzero(table)
        yield pd.DataFrame({"language": language, "bucket": bucket, "n": table[language, bucket]})

    total = np.zeros((len(languages), size))
    counted = rows.select("text", "lang").mapInPandas(run, "language int, bucket int, n long")
    for row in counted.groupBy("language", "bucket").agg(F.sum("n")).collect():  # at most languages x buckets
        total[row[0], row[1]] = row[2]
    return total


def fit(labelled: DataFrame, per_language: int = 2000, buckets: int = 8192, most_languages: int = 256) -> CodeModel:
    """Learn from ``labelled(text, lang, key)``.

    The fit uses a bounded sample: about ``per_language`` rows of each language, those with the
    smallest hashes of ``key``; all rows of a language that has fewer. Each bit is a naive Bayes
    classifier between the two sides its codeword column splits the languages into, where every
    language of a side counts alike. A bit is trusted by the distance of its two sides. More than
    ``most_languages`` languages raise: the counts that come to the driver are languages x buckets.
    Null texts, null languages and texts without a letter teach nothing.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages")
    languages = sorted(sizes)
    if not languages:
        return CodeModel((), np.zeros((0, 1)), np.zeros((buckets, 1)), np.ones(1), 1.0)
    chosen = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    table = _counts(usable.where(place < chosen[F.col("lang")]), languages, buckets)
    rates = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * buckets)
    words = codewords(len(languages)) if len(languages) > 1 else np.ones((1, 1))
    odds = [
        np.log(rates[words[:, b] > 0].mean(axis=0)) - np.log(rates[words[:, b] <= 0].mean(axis=0))
        if len(languages) > 1 else np.zeros(buckets)
        for b in range(words.shape[1])
    ]
    weights = np.stack(odds, axis=1)
    centres = rates @ weights  # expected margin of each language's own text
    gap = np.abs(centres).mean(axis=0) if len(languages) > 1 else np.ones(1)
    weights = weights / np.maximum(gap, 1e-9)  # a margin of one is a typical text
    trust = gap / gap.sum()
    return CodeModel(tuple(languages), words, weights, trust, 8.0)


def with_language(docs: DataFrame, model: CodeModel, column: str, text: str = "text", lead: float = 0.2) -> DataFrame:
    """``docs`` with a struct ``column`` of lang_pred, score and ambiguous.

    Null texts and texts without any letter get ``und``, score 0, ambiguous; so does every text
    when nothing was learned. A text is ambiguous when its score leads the next language's by less
    than ``lead``. The whole text counts, in pieces of bounded memory; repeated rows get equal
    answers; equal losses go to the first language by name. The model is languages x bits and
    buckets x bits numbers, sent with the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        own = sent.value
        known = letters.fillna(False).to_numpy(bool) & bool(own.languages)
        result = pd.DataFrame({"lang_pred": NONE, "score": 0.0, "ambiguous": True}, index=texts.index)
        if known.any():
            best, score, ahead = own.decode(np.stack([own.margins(t) for t in texts[known]]))
            result.loc[known, "lang_pred"] = np.array(own.languages, object)[best]
            result.loc[known, "score"] = np.clip(score, 0.0, 1.0)
            result.loc[known, "ambiguous"] = ahead < lead
        return result

    return docs.withColumn(column, predict(F.col(text), F.col(text).rlike(LETTER)))


def held_out(doc_id) -> object:
    """True where crc32 of the id's decimal digits leaves 1 after division by 3; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, **settings) -> CodeModel:
    """Fit on documents that are not held out; rows without an id are left out, as they have no remainder."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(usable.select("text", "lang", F.col("doc_id").alias("key")), **settings)


def identify(docs: DataFrame, **settings) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` of every row of ``docs(doc_id, text, lang, ...)``."""
    narrow = docs.select("doc_id", "text")
    found = with_language(narrow, learn(docs, **settings), "found")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.ambiguous"
    )

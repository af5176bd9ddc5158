"""Small documents with every awkward row: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, name string, size int, found int, leaks int"


def prose(seed, words, alphabet="abcdefghijklmnop"):
    drawn = random.Random(seed)
    return " ".join("".join(drawn.choices(alphabet, k=drawn.randint(2, 8))) for _ in range(words))


def rows(texts):
    """``texts`` of (doc_id, text) or (doc_id, text, lang, source) as rows of SCHEMA."""
    made = []
    for doc_id, text, *rest in texts:
        lang, source = (*rest, None, None)[:2]
        made.append((doc_id, text, lang, source, len(text or ""), 1, 2, "x", 3, 4, 5))
    return made


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def awkward():
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60)), (2, prose(2, 60)), (2, prose(2, 60)), (3, None), (4, ""), (5, " \n\t "), (6, long),
        (7, long + " end"), (None, prose(2, 60)), (None, None), (8, "one"), (9, "One"), (10, "ünï 字 \x1f x"),
    ]

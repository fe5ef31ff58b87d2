"""Fixtures: documents with copies, repeats and odd rows, made from a seeded generator."""

import numpy as np

SYLLABLES = {"en": ["the", "and", "ing", "th", "er", "on", "wh", "sh"], "de": ["der", "sch", "ung", "keit", "ü", "ß", "ein", "lich"],
             "es": ["ción", "ñ", "la", "que", "os", "ar", "ie", "ll"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n)) + "."


def corpus(n=120, seed=0):
    """(doc_id, text, lang, source, n_chars): a third from one source, with copies, near copies and shared lines."""
    rng = np.random.default_rng(seed)
    shared = [sentence(rng, "en", 14) for _ in range(3)]
    rows = []
    for i in range(n):
        lang = ["en", "en", "de", "es"][i % 4]
        lines = [sentence(rng, lang, int(rng.integers(3, 40))) for _ in range(int(rng.integers(1, 6)))]
        if i % 3 == 0:
            lines.insert(0, shared[i % len(shared)].upper() if i % 2 else "  " + shared[i % len(shared)])
        text = "\n".join(lines)
        if i % 10 == 7:
            text, lang = rows[i - 5][1:3]
        elif i % 10 == 8:
            text, lang = rows[i - 3][1].replace(".", "!", 1).swapcase(), rows[i - 3][2]
        rows.append((i, text, lang, f"src{0 if i % 3 else i % 7}", len(text)))
    return rows


#: Odd rows: nulls everywhere, empty, white space only, repeated rows, shared ids, one very long text.
ODD = [(None, None, None, None, None), (None, "the and of them.", None, None, 3), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
       (1, "another text with the same id, which is a document of its own", "en", "a", 0), (2, " \n\t\n ", "en", None, 5),
       (3, "word " * 30000, "en", "a", 150000), (4, "x", None, "b", 1), (5, "Überßüss 12 'tis don't 中文 \U0001f600", "de", "b", 20),
       (6, "a line that is long enough to count as a key of forty\n" * 7, "en", "b", 9), (7, "0123 4567 !!", "en", "b", 9)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASH = ["_id", "row", "_row", "kept", "language", "leaks", "fp", "h1", "shard", "rank", "anchor", "chunk", "held", "digest"]


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH]) if clash else df

"""Awkward rows that every operator on documents must take, and plain references for small inputs."""

import random

LONG = "word " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, shard int, key string"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "a", 1, 7, 7, 7, "x"),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0, 0, 0, ""),
        (4, " \t\n ", "en", "b", 3, 0, 0, 0, ""),
        (None, "no id here at all", "en", None, 1, 1, 1, 1, "k"),
        (None, None, None, None, None, None, None, None, None),
        (5, LONG, "en", "b", len(LONG), 1, 1, 1, "k"),
        (6, "tie tie", "en", "c", 1, 1, 1, 1, "k"),
        (7, "tie tie", "en", "c", 1, 1, 1, 1, "k"),
        (8, "again", "en", "c", 1, 1, 1, 1, "k"),
        (8, "again", "en", "c", 1, 1, 1, 1, "k"),
        (9, "Ünïcode ÀÉ 数据 \U0001f600 word", "fr", "é", 1, 1, 1, 1, "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, vocabulary=400):
    """Random texts over a small vocabulary, with exact and near copies."""
    random.seed(seed)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6))) for _ in range(vocabulary)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(20, 120))) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[n - 1]
    for i in range(0, n, 11):
        own = texts[(i * 3) % n].split()
        own[len(own) // 2] = "changed"
        texts[i] = " ".join(own)
    return texts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))

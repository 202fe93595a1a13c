"""Small tables with everything odd: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = "the of and stone river quiet morning letter garden winter harbour copper lantern meadow".split()


def prose(seed, words):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", "s", "ing", "er"]) for _ in range(words))


CLASHING = (
    "size int, hash long, fp long, keep string, nll string, threshold int, bucket int, shard string, "
    "slot int, key string, target int, rounds string, _trusted int, _key int, `first` int, n int, "
    "component_id string, __0 int, list int, spans int, terms int"
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def odd_rows():
    long = prose(1, 40_000)
    rows = [
        (1, prose(2, 80), "en", "a", 0),
        (1, prose(2, 80), "en", "a", 0),  # repeated row
        (2, prose(2, 80), "en", "a", 0),  # copy
        (3, prose(2, 80) + " end", None, "b", 0),
        (4, None, "en", "b", None),
        (5, "", "de", None, 0),
        (6, "   \n\t", "de", None, 3),
        (None, prose(3, 60), "de", "c", 1),
        (None, prose(4, 60), None, None, 1),
        (None, None, None, None, None),
        (7, long, "en", "a", len(long)),
        (8, "x" * 150_000, "fr", "a", 1),
        (9, "é" * 500 + " 😀 " + "ß" * 50, "fr", "c", 1),
        (10, "one", "en", "c", 3),
        (10, "other text of one id", "en", "c", 3),  # same id
    ]
    return [row + tuple(None if i % 2 else i for i in range(CLASHING.count(",") + 1)) for row in rows]


def odd_documents(spark):
    types = [part.strip().split(" ")[-1] for part in CLASHING.split(",")]
    rows = []
    for row in odd_rows():
        rest = [None if v is None else str(v) if t == "string" else v for v, t in zip(row[5:], types)]
        rows.append(row[:5] + tuple(rest))
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string, doc_id long")

"""Small tables that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, row string, id string, text_key double"


def word(rng):
    return "".join(rng.choice(["the", "an", "ing", "er", "st", "on", "re", "ha", "ß", "é"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def rows():
    """Nulls in every column, empty, blank, long and repeated texts, ties and repeated rows, columns with clashing names."""
    rng = random.Random(5)
    base = prose(rng, 60)
    out = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " tail", "en", "b"),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, " \t\n\x0b\x0c\r ", "de", "b"),
        (None, prose(rng, 30), "de", "a"),
        (None, None, None, None),
        (7, "one", "en", "c"),
        (8, "one two three", "en", "c"),
        (9, "ONE two THREE", "fr", "c"),
        (10, prose(rng, 20_000), "fr", "a"),
        (11, "\U0001f600 日本語 مرحبا <|endoftext|>  x", "fr", "\U0001f600"),
        (12, "x" * 5000, "en", "￿"),
        (13, "123 456 !!!", "en", None),
        (14, prose(rng, 40), "de", "a"),
        (14, prose(rng, 40), "de", "a"),
    ]
    out += [(20, "same row " * 5, "en", "a")] * 3
    out += [(100 + i, prose(rng, rng.randint(5, 80)), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "c"])) for i in range(40)]
    return [(i, t, la, s, None if t is None else len(t), 7, "s", "r", "i", 0.5) for i, t, la, s in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)

"""Small fixtures with the cases every text operator must take: NULLs, empty and long texts, ties, repeats, extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _k string"


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if i % 5 == 0:
            words[10:10] = passage.split()
        text = ".\n".join(" ".join(words[k : k + 12]).capitalize() for k in range(0, len(words), 12))
        rows.append((i, text, "en", f"s{i % 4}", len(text), "x", "y"))
    base = rows[1][1].split()
    for k in range(6):  # near copies, each with one changed word
        copy = list(base)
        copy[3 + k] = f"other{k}"
        rows.append((100 + k, " ".join(copy), "en", "s0", 1, None, None))
    rows += [(200, rows[2][1], "en", None, 1, "x", "y"), (200, rows[2][1], "en", None, 1, "x", "y")]  # a repeated row that is a copy
    rows += [(201, None, None, "s1", None, None, None), (202, "", "en", "s1", 0, None, None), (203, " \t\n", None, None, 3, None, None), (None, rows[3][1], "en", "s2", 1, None, None)]
    rows += [(204, "one two", "en", "s3", 7, None, None), (205, "ha " * 400, "en", "s3", 1200, None, None), (206, " ".join(rng.choice(vocab) for _ in range(20_000)), "en", "s0", 1, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return (text or "").encode().split()


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))

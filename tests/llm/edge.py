"""Documents with every awkward case, and columns named like the operators' own."""

import random

from pyspark.sql import SparkSession

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row int, size int, key int, ids int, "
          "hits int, score double, id string, pattern int, position int, scores int, h int")


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(words))


def texts() -> list[tuple]:
    copy = prose(60, 1)
    near = copy.split()
    near[30] = "changed"
    return [
        (1, copy, "en", "a"), (2, copy, "en", "b"), (3, " ".join(near), None, None), (4, None, "en", "a"), (5, "", "en", "a"),
        (6, " \t\n ", "en", "b"), (7, "one two", "en", "c"), (8, "one  two\n", "en", ""), (None, prose(40, 2), "en", "a"),
        (None, prose(40, 3), "en", None), (9, LONG, "en", "a"), (10, prose(50, 4), "en", "a"), (10, prose(50, 4), "en", "a"),
        (11, "a" * 70_000, "en", "a"), (12, prose(45, 5) + " x　y \x1c z é", "en", "d"),
    ]


def frame(spark: SparkSession, rows: list[tuple] | None = None):
    rows = texts() if rows is None else rows
    full = [(i, t, lang, s, len(t or ""), 1, 2, 3, 4, 5, 0.5, "x", 6, 7, 8, 9) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)

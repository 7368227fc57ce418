"""Small tables with every awkward case, and readers of results."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, mark string, copy string, doc string"

_WORDS = ("the of and river stone walks bright under many paths quiet morning when she found seven small lamps "
          "near old harbour walls before rain came down again").split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + r.choice(("", "", "", ",", ".")) for _ in range(words))


def lines(seed: int, n: int, words: int = 9) -> str:
    return "\n".join(prose(seed * 1000 + k, words) for k in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows; the other columns clash with names the operators use."""
    passage = lines(77, 5)
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one  "), (6, "o n e"), (7, lines(7, 400)),
        (8, lines(8, 12)), (9, lines(8, 12)), (10, lines(8, 12) + " again"), (11, passage + "\n" + lines(11, 6)),
        (12, lines(12, 3) + "\n\n" + passage + "\n" + lines(13, 2)), (13, passage), (14, "a " * 60), (15, "x" * 30000),
        (8, lines(8, 12)), (16, "é" * 40 + "\n" + prose(16, 50)), (None, None), (None, "no id " * 12), (17, None),
        (18, "line\n" * 30 + prose(18, 40)), (19, "  " + prose(19, 30)), (20, prose(19, 30)), (9, prose(20, 25)),
    ]
    return [(i, t, (None, "en", "de", "fr")[k % 4], (None, "src0", "src1")[k % 3], len(t or ""), k, "m", None, "d")
            for k, (i, t) in enumerate(texts)]


def table(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

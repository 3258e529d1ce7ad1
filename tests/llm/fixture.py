"""A small table with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names the operators use inside.
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, n_words bigint, "
          "score double, home bigint, bucket bigint, rep bigint, w string, n bigint, y int, features string, "
          "_id string, _text string")


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "of", "and", "in", "to", "river", "stone", "lamp", "quiet", "garden", "winter",
                                "letter", "morning", "harbour", "engine", "copper", "north", "valley", "paper"))
                    + rng.choice(("", "", "", ",", ".")) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, lang): nulls, empties, ties, repeats, copies, a very long text."""
    base, passage = prose(120, 1), prose(60, 2)
    words = base.split()
    near = " ".join(words[:50] + ["changed"] + words[51:])
    shout = " ".join(["BUY!! NOW!!"] * 40)
    odd = "Ünïcode çedilla ÄÖÜ ſ K İ \x1c \x85 <|endoftext|> 中文 текст ελληνικά   tab\tend\n\nline"
    return [
        (1, base, "en"), (2, base, "en"), (3, near, None), (4, prose(120, 3) + " " + passage, "en"),
        (5, passage + " " + prose(90, 4), "en"), (6, None, "en"), (7, "", "en"), (8, " \n\t ", None),
        (9, "one", "en"), (10, "one", "de"), (11, shout, "en"), (None, prose(80, 5), "en"), (None, None, None),
        (12, prose(30_000, 6), "en"), (13, odd, "fr"), (14, odd, "fr"), (15, "x" * 30_000, "en"),
        (16, prose(40, 7), "en"), (16, prose(40, 7), "en"), (17, passage + " " + passage, "en"),
        (18, "Line one here\nLine one here\n\n \nLine one here # * $", "en"),
    ]


def frame(spark: SparkSession, rows=None) -> DataFrame:
    from reportlake.llm.common import tuned
    rows = texts() if rows is None else rows
    return tuned(spark).createDataFrame(
        [(i, t, lang, "s", len(t) if t else None, 7, 7, 0.5, 7, 7, 7, "w", 7, 1, "f", "id", "text")
         for i, t, lang in rows], SCHEMA)


def by_row(df: DataFrame, *cols: str) -> list[tuple]:
    """Rows without regard to order."""
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

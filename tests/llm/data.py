"""Documents with nulls, ties, repeats, a very long text and columns named like the operators' own."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("kept", "hash", "row", "size", "print", "position", "ids", "text_hash", "first", "digest", "id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(seed: int, n: int, vocabulary: int = 900) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + rng.choice(["", "", "", "", ",", ".\n" if i % 9 == 0 else "."]))
    return " ".join(out)


def edited(text: str, every: int) -> str:
    return " ".join(f"{w}x" if i % every == every // 2 else w for i, w in enumerate(text.split(" ")))


def rows() -> list[tuple]:
    base = prose(1, 400)
    texts = [
        (1, base), (2, base), (3, edited(base, 180)), (4, prose(2, 300)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"),
        (9, prose(3, 200_000)), (10, "word " * 400), (11, base.replace(" ", "  ")), (12, prose(4, 120)),
        (13, "Zażółć gęślą jaźń 中文 😀 naïve text " * 12), (14, "A line of words that repeats.\n" * 3 + prose(5, 90)),
        (None, prose(6, 80)), (None, prose(6, 80)), (12, prose(4, 120)), (12, prose(7, 120)), (-3, "\n\n"), (15, base.upper()),
    ]
    sources = ["a", "b", None, "a", "Z", "é", "a", "b", None, "a"]
    return [(i, t, "en", sources[k % 10], None if t is None else len(t), *["x"] * len(CLASHING)) for k, (i, t) in enumerate(texts)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

"""Plain loops that the corpus operators are compared with."""

from __future__ import annotations

import hashlib
import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra: str = "", ids=None):
    """Rows of documents; ``extra`` adds a column of that name whose values clash with nothing."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), *(["x"] if extra else [])) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCUMENTS + (f", {extra} string" if extra else ""))


def prose(draw: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(words))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, repeated, non-Latin and long texts."""
    draw = random.Random(5)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "one",
        "Two words",
        "naïve café Ünïcode ß İstanbul ΟΔΟΣ",
        "漢字かな交じり文 emoji 😀😀 fin",
        "a" * 5000,
        "-" * 3000 + "\x1f\x85\xa0 end",
        prose(draw, 4000),
        "it's we'll  three   blanks\n\n\nlines 12345 67,8.9 <|endoftext|>",
    ]


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def least_reachable(n: int, linked) -> list[int]:
    """The least number each of n items reaches over ``linked`` pairs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]

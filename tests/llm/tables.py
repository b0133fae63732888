"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names, and word soup."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, same string, hash string, root long, node string, score double, keep boolean, tokens long, rows string, y double"


def soup(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *((r[2], r[3]) if len(r) > 2 else ("en", "s0")), None, 1, "x", "h", 2, "n", 0.5, False, 9, "r", 1.0) for r in rows]
    return spark.createDataFrame(full, DOCS)


def messy(spark):
    """Every irregularity at once. 1, 2 and the repeated 3 are alike; 9 is long."""
    same = " ".join(soup(1, 80))
    long = " ".join(soup(2, 60_000, 50_000))
    return docs(
        spark,
        [(None, same), (None, None), (1, same), (2, same), (3, same), (3, same), (4, None), (5, ""), (6, ""), (7, " \n\t "), (8, "one"), (9, long), (10, "Ünïcode ßtraße 漢字 🙂 !"), (11, " ".join(soup(3, 80)), None, None), (12, " ".join(soup(4, 80)), "en", None)],
    )


def empty(spark):
    return docs(spark, [])

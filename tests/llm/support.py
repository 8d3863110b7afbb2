"""Awkward documents and small brute-force versions that the tests share."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin long, fp string, id int, __id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", "web", None if t is None else len(t), 7, "x", 1, 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(4000)]
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t "),
        (4, "One short line."),
        (4, "One short line."),
        (5, "One short line."),
        (None, "No number at all, but a text."),
        (None, None),
        (6, " ".join(words)),
        (7, "a" * 3000),
        (8, "Ünïcode ςΣ 你好 — naïve 🎉🎉 \u00a0\u2003 x\r\n  y\x0b\x1c z  " * 5),
        (9, "x  y   z \n\n  tabs\t\tand 'll we'll 12345 ... !!! " * 20),
        (10, "ab" * 700 + " " + "ab" * 700),
        (11, "\n".join(["Home | About | Contact | Shop", "A line that ends well, as it should."] * 30)),
        (12, "\u0130I ŉ ﬁ ß ẞ Ǆ" * 4),
    ]


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(docs):
    """(doc_id, text) of every row, null texts empty."""
    return [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: str(r))


def empty(spark):
    return table(spark, [(1, "x")]).where(F.lit(False))

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def passage(n: int, seed: int = 7) -> str:
    """n words without repeats nearby."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991:x}" for i in range(n))


#: id, text, language, source: null and empty, short, ties, repeats, rows that stand twice, odd spaces, beyond ASCII, very long.
ROWS = [
    (1, passage(60), "en", "a"),
    (2, passage(60), "en", "a"),
    (3, f"{passage(30, 3)} {passage(60)} {passage(30, 4)}", "en", None),
    (4, None, "en", "a"),
    (5, "", "fr", "a"),
    (6, " \t\n ", None, "b"),
    (7, "one two", "fr", "b"),
    (8, "a " * 400, "en", "b"),
    (9, f"{passage(25, 5)}\n{passage(25, 5)}\r\v{passage(25, 5)}", "en", "a"),
    (10, "Élan vital — naïve café ▁ 日本語 \U0001f600 \x00 zero " * 12, "fr", "c"),
    (11, passage(60), "en", "a"),
    (11, passage(60), "en", "a"),
    (12, "Élan vital — naïve café ▁ 日本語 \U0001f600 \x00 zero " * 12, "fr", "c"),
    (13, "x" * 3000, "en", "c"),
    (14, passage(20_000, 9), "en", "c"),
    (15, passage(20_000, 9) + " tail", "en", "c"),
    (16, LONG, "en", "a"),
    (17, LONG.upper() + " !! ## $$", "en", "a"),
    (None, passage(60), "en", "a"),
    (-5, passage(60, 11), "en", "a"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """The rows above, with columns whose names clash with those that operators make or look for."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    odd = df.select("doc_id", "text", "lang", "source", F.length("text").cast("long"), F.lit("no"), F.lit(1), F.lit(2), F.lit(3), F.lit("z"))
    return odd.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "k", "t", "fp", "doc_id").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df) -> list[tuple]:
    return [(r[0], r[1]) for r in df.select(*[df[c] for c in ("doc_id", "text")]).collect()]


def texts_of(df) -> list[tuple]:
    """(id, text) by position, as names may clash."""
    return [(r[0], r[1]) for r in df.collect()]


def by_id(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return out

from __future__ import annotations

import random

import pytest

BASE = [f"w{i}" for i in range(120)]


def edited(words: list[str], times: int, draw: random.Random) -> str:
    words = list(words)
    for _ in range(times):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, TEXT): nulls in every column, empty and long texts, repeated rows, copies, a hot source."""
    draw = random.Random(3)
    texts = [None, "", "   \n\t ", "x", "Hello World", "hello  WORLD", "a " * 90, "x y " * 60, " ".join(BASE), " ".join(BASE), " ".join(BASE[5:]) + " end", "über ß <|endoftext|> don't stop <|im_end|>"]
    texts += [edited(BASE, draw.randrange(6), draw) for _ in range(12)]
    texts += [" ".join(f"q{draw.randrange(50)}" for _ in range(draw.randrange(1, 80))) for _ in range(20)]
    texts.append(" ".join(f"long{i % 997}" for i in range(20_000)))
    texts.append('password = "hunter2hunter2" AKIAABCDEFGHIJKLMN token: short deadbeefdeadbeef01 secret:token=abcdefghijkl')
    out = [(i, t, ("en", "de", None)[i % 3], ("hot", "hot", "b", None)[i % 4], len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*out, out[8], (None, "no id at all", "en", "hot", 12, "clash"), (None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "true")
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return made


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string, kept string, fingerprint string, score string, component_id string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, and columns with clashing names."""
    clash = ("a", "b", "c", "d", "e", "f")
    plain = "the cat sat on the mat and the dog ran over to the house by the river while it was raining " * 4
    rows = [
        (1, plain, "en", "s", 10, *clash), (1, plain, "en", "s", 10, *clash), (2, None, "en", "s", None, *clash), (3, "", "en", None, 0, *clash), (4, " \t\n ", None, "s", 4, *clash),
        (None, plain + "x", "en", "s", 3, *clash), (None, None, None, None, None, *[None] * 6), (5, "wort " * 60_000, "de", "s", 9, *clash), (6, "x" * 200_000, "de", "s", 9, *clash),
        (7, "12345 !!! ###", "de", "t", 3, *clash), (8, "naïve façade — “quotes” 漢字 emoji 😀 é \x00 end", "fr", "t", 3, *clash), (9, "<|endoftext|> inside  double  spaces\r\n\r\nand lines", "en", "t", 3, *clash),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("false")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

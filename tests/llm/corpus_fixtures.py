from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like results."""
    long = " ".join(f"wort{k % 5000}" for k in range(60_000))
    rows = [
        (1, "one two three four five six seven eight", "en", "a"),
        (1, "one two three four five six seven eight", "en", "a"),
        (2, "one two three four five six seven eight", None, None),
        (3, None, "en", "a"),
        (4, "", "de", "b"),
        (None, "three words only", "en", None),
        (None, None, None, None),
        (5, long, "fr", "b"),
        (6, "  \n\t ", "fr", "b"),
        (7, "é" * 50, "fr", "c"),
        (8, "a.b@c.de 4111 1111 1111 1111 +1 (502) 555-6996, 10.0.0.1", "en", "a"),
    ]
    names = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(rows, names)
    return frame.selectExpr("*", "1 AS n_chars", "'x' AS row", "2 AS size", "3 AS kept", "4 AS id", "5 AS n_words", "6 AS shard", "7 AS slot", "8 AS component_id")


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [
        (1, "http://a.b/x", "<p>Hallo &amp; Welt</p>"),
        (1, "http://a.b/x", "<p>Hallo &amp; Welt</p>"),
        (2, None, None),
        (None, "no url", ""),
        (None, None, "<article>text<br>more</article>"),
        (3, "http://a.b/y\r\nX: y", "WARC/1.1\r\n" * 3 + "é" * 70_000),
        (4, "http://a.b/z", "<p>" + "wort " * 50_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS key", "3 AS host")

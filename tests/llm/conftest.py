"""Documents with every odd case, beside the session of the other tests."""

from __future__ import annotations

import random

import pytest

from termscan.llm.storage import ship_package

SCHEMA = "doc_id long, text string, lang string, n_words long, rank int, row long, kept string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): nulls, empty and very long texts, ties, repeats, copies, near copies."""
    rng = random.Random(7)

    def prose(n: int) -> str:
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(n))

    base, passage = prose(200), prose(60)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    return [
        (5, base), (3, base), (9, near), (7, prose(80) + "\n" + passage), (8, passage + " " + prose(70)),
        (None, base), (None, None), (2, None), (1, ""), (4, "  \n\t "), (6, "one two three"), (6, "one two three"),
        (10, "same " * 120), (11, "same " * 120), (12, prose(9000)), (13, "Ünï cödé wörds 日本\n"), (14, prose(49)),
        (15, prose(50)), (15, prose(55)),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    """The same with other columns, some named like results of the operators."""
    rows = [(doc_id, text, "xx", -1, -2, -3, "no") for doc_id, text in odd_texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

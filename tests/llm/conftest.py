import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, fp string, kid string, __nll double"


def rows_of(spark, texts):
    """documents with extra columns whose names clash with the operators' own."""
    rows = [(d, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), k, "x", "y", 0.5) for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture
def edge():
    """(doc_id, text) with nulls, empty and blank texts, a long text, copies, repeated rows, repeated and null ids."""
    long, passage = words(1, 6000), words(2, 120)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (6, "a  b"), (7, "a b c d e"), (8, long), (9, long), (9, long), (9, "other " + words(3, 50)),
        (None, "a b"), (None, long), (None, None), (10, words(4, 80) + " " + passage + " " + words(5, 60)), (11, passage), (12, words(6, 30) + " " + passage),
        (13, "é" * 500), (14, "é" * 500 + "ü"), (15, "x" * 3000), (16, "ab" * 700), (17, words(7, 300)), (18, words(7, 300).replace(" ", "\n", 40)),
        (19, "A B C D E"), (20, words(8, 40) + " " + words(8, 40)), (21, "nul\u0000in side"), (22, "   "), (23, words(2, 119)),
    ]


@pytest.fixture
def docs(spark, edge):
    return rows_of(spark, edge)


@pytest.fixture
def none(docs):
    return docs.limit(0)

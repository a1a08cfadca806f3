import pytest

#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.\n"),
    (2, None),
    (3, ""),
    (4, "   \n\t\n  "),
    (5, "naïve “quotes” — ça été là 漢字 🎉 it's we'll  two  spaces ▁under <s> <|endoftext|> x"),
    (6, "word " * 30_000),
    (7, "a" * 5_000),
    (8, "The cat sat on the mat.\nThe cat sat on the mat.\n"),
    (8, "The cat sat on the mat.\nThe cat sat on the mat.\n"),
    (None, "no key | here | at > all\x00 é"),
    (9, "### *** $$$\n| a | b | c |\nBUY!! NOW!! HERE!!"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

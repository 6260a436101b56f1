import random

import pytest

from llm_helpers import prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls in every column, ties, repeats, extremes and clashing names."""
    rng = random.Random(3)
    base = prose(rng, 80)
    near = base.replace(base.split()[40], "other")
    rows = [
        (1, base, "en", "src1"),
        (2, near, "en", "src2"),
        (2, near, "en", "src2"),
        (2, prose(rng, 30), "en", "src2"),
        (3, base, None, "src3"),
        (None, base, "en", None),
        (None, None, None, None),
        (4, None, "en", "src1"),
        (5, "", "en", "src1"),
        (6, " \t\n\x0b ", "en", "src1"),
        (7, "one", "en", "src0"),
        (8, "one two three", "de", "src0"),
        (9, "ONE two x three", "de", "src0"),
        (10, "x" * 60_000, "en", "src9"),
        (11, prose(rng, 20_000) + "\n" + base, "en", "src1"),
        (12, base + "\n" + base, "fr", "odd"),
        (-5, "é漢\U0001f600 'll don't  \n\n  x" * 9, "fr", "src5"),
    ]
    more = ["kept", "n_words", "quality", "lines", "mix", "ids", "n_tokens", "words", "row", "again", "place"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in more)
    return spark.createDataFrame([(*r, *range(len(more))) for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)

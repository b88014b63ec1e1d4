import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture
def odd(spark):
    """Documents with nulls, blanks, repeats, ties, a long text, and columns
    named like those that operators make."""

    def make(*texts):
        rows = [(i, t, "en", "s", 0, "x", 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, key int")

    return make


def brute_words(text, lower=False):
    import re

    t = text or ""
    if lower:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)

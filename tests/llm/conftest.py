import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, label double, score double, mask int, shard int, part int, n long, stats binary, node long, length long, rank int, ids binary, sequence_id long"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or ""), *[None] * 14) for i, t in enumerate(texts)]


WORDS = "the of and river stone light winter garden paper music silver road morning letter water bridge".split()


def sentence(i, n=12):
    return " ".join(WORDS[(i * 7 + k * (3 + i % 5) + k * k) % len(WORDS)] for k in range(n)).capitalize() + "."


#: Nulls, blanks, ties, repeats, signs of other scripts, long words and a long text.
ODD = [None, "", "   \n\t", "a", "Word", "Word", "日本語 ﬁ ﻻ", "x" * 5000, "\x1c \x85 <|endoftext|> ** !!!", " ".join(sentence(k) for k in range(900)), *(sentence(k) for k in range(20)), sentence(3)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, a null id, repeated rows and extra columns of clashing names."""
    rows = rows_of(ODD)
    return spark.createDataFrame([*rows, rows[4], rows[12], (None, "no id here", None, None, None, *[None] * 14)], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

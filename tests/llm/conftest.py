import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows with clashing extra columns."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, lang string, n long, __w string")
        return df.repartition(3) if rows else df

    return make


#: Nulls, empties, white space, one long word, a very long text, repeats and ties.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "x" * 5000), (6, "word " * 20000), (7, "same text here twice over and over"), (8, "same text here twice over and over"), (None, "no id at all"), (9, "Ünï 日本 🎉 ¹²"), (7, "same text here twice over and over")]


@pytest.fixture
def odd():
    return list(ODD)

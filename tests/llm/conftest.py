"""Documents with the awkward cases that every operator must take."""

import pytest

EXTRA = [
    (900001, None, None, None, None),
    (900002, "", "en", "src0", 0),
    (900003, "   \n\t ", "en", None, 6),
    (900004, "12345 !!!", None, "src0", 9),
    (900005, "same words again " * 40, "en", "src1", 680),
    (900006, "same words again " * 40, "en", "src1", 680),
    (900007, "wort und wörter " * 3000, "de", "src1", 48000),
    (900008, "x", "en", "src2", 1),
    (900008, "x", "en", "src2", 1),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows alone, with columns whose names operators use inside."""
    rows = [(*r, "clash", 7, 1) for r in EXTRA]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, label int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)

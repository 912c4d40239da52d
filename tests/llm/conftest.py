import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, _row string, _size long, place long, quality int, held_out string, text_hash string"
#: Names that operators use inside themselves.
EXTRA = (0.5, 7, "x", 3, 1, 0, "y", "z")


def prose(rng, words=60, vocabulary=400):
    out = []
    for _ in range(words):
        k = rng.randrange(vocabulary)
        out.append("".join("aeioulnrst"[(k * 7 + j * 3) % 10] for j in range(2 + k % 6)))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows and ids."""
    rng = random.Random(5)
    rows = [(i, prose(rng), "en" if i % 3 else "fr", f"src{i % 4}", 10) for i in range(40)]
    rows += [(100, None, "en", "src0", None), (101, "", "en", "src1", 0), (102, " \n\t ", None, "src2", 4), (103, prose(rng), None, None, 5), (None, prose(rng), "fr", "src1", 5), (None, None, None, None, None)]
    rows += [(104, prose(rng, 40_000, 5_000), "en", "src0", 9), (105, "one", "en", "src0", 3), (106, "one", "en", "src3", 3)]
    rows += [(110, "one  <|endoftext|> two<|endoftext|>", "en", "src0", 30)]
    rows += [rows[3], rows[3], (107, rows[3][1], "fr", "src2", 1), (108, "Ünï çødé ☃ \U0001f600 " * 20, "fr", "src1", 1), (109, "### *** " * 30, "en", "src1", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in odd_rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(40)] + [(3, 1, 0), (3, 1, None), (None, 1, 0), (100, None, 1), (101, 0, 0), (109, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

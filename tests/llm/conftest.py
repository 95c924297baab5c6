import random

import pytest

SF0001, SF001 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Extra columns with names that operators use for their results or inside.
CLASHING = "score double, rank int, lang_pred string, _id long, piece int, vertex long, kept boolean"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """(doc_id, text, clashing columns): null and empty texts, a null id, repeated rows, ties, a very long text, control
    characters and special tokens."""
    rng = random.Random(3)
    words = ["the", "a", "Éta", "naïve", "license", "mit", "x" * 300, "<|endoftext|>", "don't", "123", "漢字", "🙂", "\x1c", "!!"]
    long_text = " ".join(rng.choice(words) for _ in range(30_000)) + "y" * 5_000
    texts = [None, "", " \n\t ", "one", "MIT License", "the the the the", "a b c d e f g h i j", long_text, "é ́ x\x1fy  z w\x85v",
             "<|endoftext|> and <|startoftext|>", "line\nline\nline", "İSTANBUL ſ K ΑΣ"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "MIT License"), (None, "no id here"), (3, "another text, same id"), (20, "one")]
    return spark.createDataFrame([(i, t, 0.5, 1, "zz", 7, 3, 9, True) for i, t in rows], "doc_id long, text string, " + CLASHING)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, " + CLASHING)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, start string"
#: Odd rows: nulls, empty and long texts, ties, repeated rows, other scripts, special strings; columns with clashing names.
TEXTS = [
    None, "", " ", "\n\t", "one", "ONE two three  four", "it's we're 'll d' !'s", "<|endoftext|>x<|STARTOFTEXT|> <|startoftext|>",
    "J̌ KK İstanbul é é 中文字 \U0001f600 ​ \x1c a\x1db", "▁▁ x ▁y  ", "a" * 3000,
    "word " * 5000, "the same text", "the same text", "</s><s><unk> <0x0A>\r\nz", "12 345 3.14 a1b2 $9,99",
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None, "s", None, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", None, 5, None, None), (3, "repeated id", "en", "s", 1, "x", "y"),
             (3, "repeated id", "en", "s", 1, "x", "y"), (-7, "negative", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """(doc_id, text) of the small documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]

"""Small tables that hold what real ones may: nulls, empty texts, ties, repeated rows, columns with awkward names."""

import os

import pytest

TOKENIZER = os.environ.get("FEEDERFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil many odd potions near grey rivers".split()


def sentence(k: int, n: int = 40) -> str:
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str((k * i) % 11) for i in range(n))


@pytest.fixture(scope="session")
def rows():
    base = [(k, sentence(k), "en" if k % 2 else "de", f"src{k % 4}") for k in range(30)]
    base += [(100, sentence(3), "en", "src0"), (101, sentence(3) + " end", "en", "src1"), (102, None, "en", None), (103, "", None, "src2"), (104, "  \n", "de", None), (105, "Two words", "en", "src3")]
    base += [(5, sentence(5), "en", "src1"), (None, sentence(6), "en", "src2"), (106, "ÜBER " * 3000 + "x", "de", "src1"), (107, "<|endoftext|>a  b\n\n c<|endoftext|>", "en", "src0")]
    return base


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, fp double, blob string, block int, size int"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 0.5, None, 7, None) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

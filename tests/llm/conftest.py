import random

import pytest
from pyspark.sql import types as T

ODD = [
    None, "", " ", "\n\n", "a", "A b", "Ünïcode  two spaces ", "tab\tand\x0bvt\x1cfs\x85nel", "x" * 5000, "é combining ́x",
    "naïve café, été. ΣΑΣ ΟΔΟΣ İstanbul", "emoji 😀😀 and � ▁mark▁▁ in", "<|endoftext|> <|EndOfText|> <s></s> <0x41>", "don't we'll I'd 3.14 1,000 a1b2",
    "line one here\nline one here\nline three", "  leading and trailing  ", "日本語のテキスト 中文 字", "!!! ??? ... ,,, ;;;", "nul\x00byte", "word " * 3000,
]


def words_text(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns with the names that operators give."""
    rng = random.Random(3)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id here"), (3, "again"), (3, "again"), (100, None)]
    rows += [(200 + k, words_text(rng, rng.choice([3, 40, 400]))) for k in range(60)]
    rows += [(300 + k, rows[40][1]) for k in range(4)]
    return spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], "doc_id long, text string, raw string, n_tokens int, ids string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))

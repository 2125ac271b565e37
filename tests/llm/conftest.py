import os
import random

import pytest

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def tokenizer():
    from huddle.llm.tokens import default_tokenizer
    return default_tokenizer()


@pytest.fixture(scope="session")
def docs_rows():
    """Rows with every awkward case: nulls, empty and long texts, repeated rows, copies."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = prose(120)
    words = base.split()
    rows = [(i, prose(r.randint(1, 90)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, base, "en", "s0", 0), (101, base, "en", "s0", 0), (102, " ".join(words[:60] + ["zz"] + words[61:]), "en", "s0", 0),
             (103, None, None, None, None), (104, "", "en", "s1", 0), (105, "   \n ", "en", "s1", 0),
             (106, prose(30_000), "de", "s0", 0), (107, "Ünï cödé — 日本 😀 " + prose(10), "fr", "s1", 0),
             (40, rows[0][1].upper(), "en", "s1", 0), (5, rows[5][1], "en", "s2", 0), (None, prose(20), "en", "s2", 0)]
    rows += [(None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    from huddle.llm.common import importable
    importable(spark)
    df = spark.createDataFrame(docs_rows, "doc_id long, text string, lang string, source string, n_chars long")
    # extra columns whose names clash with what operators use
    return df.selectExpr("*", "1L as n", "'x' as root", "2L as start", "'y' as _key", "3L as hash", "0 as part", "'k' as kind")


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")

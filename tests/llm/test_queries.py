"""Every text query runs over its whole table; those without SQL say where they are tested instead."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, spark_rows
from tillwork.llm.queries import QUERIES, SQL

#: Why SQL can't express a query, and the test that takes its place.
WITHOUT_SQL = {
    "op1_line_crf": "a trained model; test_llm.py has its marginals by enumeration and held-out accuracy",
    "op2_weighted_sampling": "random variables by hashing; test_llm.py samples plainly",
    "op3_suffix_dedup": "every 200-byte string of all texts; test_llm.py counts them plainly",
    "op4_zstd_toxicity": "a compressor; test_llm.py has its distances and held-out accuracy",
    "op5_unigram_counts": "a tokenizer; test_llm.py has the tokenizers library",
    "op6_byte_bpe": "a tokenizer; test_llm.py has the tiktoken library",
    "op8_cap_filters": "too slow on whole tables; test_llm.py compares all pairs",
    "op9_packing": "a tokenizer and a linear program; test_llm.py checks every piece",
    "op10_circulant_minhash": "too slow on whole tables; test_llm.py compares all pairs",
    "op12_periodic_runs": "nested searches of every period; test_periodic_runs.py tries them all",
    "op13_word_bpe": "a tokenizer; test_word_bpe.py has the tokenizers library",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_its_rows(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert spark_rows(df)[1] and WITHOUT_SQL[name]


def test_pipeline_is_registered():
    assert "pipeline" in entry.queries() and set(QUERIES) < set(entry.queries())
    assert set(SQL) | set(WITHOUT_SQL) == set(QUERIES)

"""BPE with word ends against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwork.llm import word_bpe
from tillwork.llm.common import prepare
from tillwork.llm.queries import WORDS, op13_word_bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PIECES = (
    "a b e ' s re The ing <|endoftext|> <|startoftext|> <| 1 ² é é Σ ΑΣ İ 漢 字 😀 \x1c \x85 \xa0 ſ ǅ ़ ! _ - 've don't"
).split(" ") + [" ", "  ", "\n", "\t"]


def samples():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*mixed, "ab" * 3000 + "漢" * 500, "x" * 1000, "word " * 2000, "", " ", "No <|endoftext|>space"]


def ids(found):
    return np.frombuffer(found, "<u4").tolist()


@pytest.mark.parametrize("short", [1, 64, 1 << 20])
def test_ids_of_mixed_texts(short, monkeypatch):
    monkeypatch.setattr(word_bpe, "SHORT", short)
    known = word_bpe.Words(WORDS)
    for text in samples() if short < 1 << 20 else samples()[:400]:
        assert ids(known.text(text)) == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_blocks_from_space_to_space(monkeypatch):
    known = word_bpe.Words(WORDS)
    whole = [known.text(t) for t in samples()]
    monkeypatch.setattr(word_bpe, "BLOCK", 3)
    assert [known.text(t) for t in samples()] == whole


def test_code_points_by_themselves():
    known = word_bpe.Words(WORDS)
    for first in range(1, sys.maxunicode, 4000):
        points = [c for c in range(first, min(first + 4000, sys.maxunicode + 1), 1 if first < 0x3000 else 17)]
        text = [f"a{chr(c)}1" for c in points if not 0xD800 <= c < 0xE000]
        for t, e in zip(text, LIBRARY.encode_batch(text, add_special_tokens=False), strict=True):
            assert ids(known.text(t)) == e.ids, t


def test_a_full_cache_forgets(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE", 2)
    known = word_bpe.Words(WORDS)
    text = "one two three one two three four"
    assert ids(known.text(text)) == LIBRARY.encode(text, add_special_tokens=False).ids and len(known) <= 2


def test_rows(spark):
    """Null and empty texts, null and repeated ids, additional columns, an empty table, a very long text."""
    prepare(spark)
    rows = [(1, None), (2, ""), (3, "Two  words"), (3, "Two  words"), (None, "it's"), (4, "long text " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    got = word_bpe.decode(word_bpe.encode(docs, WORDS), WORDS)
    assert got.columns == ["doc_id", "ids", "decoded"]
    found = sorted((str(r.doc_id), ids(r.ids), r.decoded) for r in got.collect())
    want = []
    for key, text in rows:
        own = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((str(key), own, LIBRARY.decode(own, skip_special_tokens=False)))
    assert found == sorted(want)
    assert word_bpe.decode(word_bpe.encode(docs.where("1 = 0"), WORDS), WORDS).collect() == []


def test_query_against_the_library(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op13_word_bpe(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        own = LIBRARY.encode(text, add_special_tokens=False).ids
        decoded = LIBRARY.decode(own, skip_special_tokens=False)
        assert got[key].n_tokens == len(own)
        assert got[key].ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()

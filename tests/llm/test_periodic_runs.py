"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.llm import periodic_runs
from tillwork.llm.common import prepare
from tillwork.llm.queries import op12_periodic_runs


def plain_runs(words):
    """Every stretch of every period; of equal stretches the least period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng, most=160):
    n, kinds = rng.randint(0, most), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 4:
            p, s = rng.randint(1, max(1, n // 3)), rng.randrange(n)
            for i in range(s + p, rng.randint(s, n)):
                words[i] = words[i - p]
    return [f"w{x}" for x in words]


def numbered(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def listed(words):
    return list(zip(*[x.tolist() for x in periodic_runs.runs(numbered(words), len(words))], strict=True))


@pytest.mark.parametrize("cells", [1 << 19, 40])
def test_runs_of_small_texts(cells, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CELLS", cells)
    rng = random.Random(5)
    for _ in range(300):
        words = repetitive(rng)
        assert listed(words) == plain_runs(words), words


def test_overlapping_and_nested_runs():
    a, b = "a", "ab"
    while len(b) < 500:
        a, b = b, b + a
    assert listed(b[:500]) == plain_runs(b[:500])
    nested = (("x " * 15 + "y ") * 4 + "z ").split() * 3
    assert listed(nested) == plain_runs(nested)


def test_long_texts():
    assert listed(["a"] * 100_000) == [(0, 100_000, 1)]
    assert listed(list(range(5000)) * 7 + ["end"]) == [(0, 35_000, 5000)]


def test_transform_turns_back_exactly():
    rng = np.random.default_rng(2)
    for n in (2, 8, 64, 1024):
        x = rng.integers(0, int(periodic_runs.PRIME), (3, n)).astype(np.uint64)
        assert (periodic_runs.back(periodic_runs.transform(x.copy())) == x).all()


def test_seeds_are_all_places_without_a_mismatch():
    rng = np.random.default_rng(3)
    for size in (2, 4, 16):
        least = 1 if size == 2 else 2 * size - 1
        codes = np.concatenate([rng.integers(0, 2, 40 * size), np.zeros(5 * size, np.int64)]).astype(np.uint64)
        blocks = np.arange(0, 40 * size, size)
        at, distance = periodic_runs._again(codes, blocks, size, least)
        want = [
            (b, d)
            for b in blocks
            for d in range(least, 4 * size - 1)
            if (codes[b : b + size] == codes[b + d : b + d + size]).all()
        ]
        assert sorted(zip(at.tolist(), distance.tolist(), strict=True)) == want


def test_rows(spark):
    """Null and empty texts, null and repeated ids, odd white space, additional columns, an empty table."""
    prepare(spark)
    rng = random.Random(8)
    texts = [None, "", " \x0b\x0c\r\n\t ", "a\x0bb " * 20, "a\xa0b\x85c " * 6, *[" ".join(repetitive(rng)) for _ in range(40)]]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse(docs).collect())
    want = []
    for key, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        want.append((str(key), len(words), plain_runs(words), plain_collapsed(words, plain_runs(words))))
    assert got == sorted(want)
    assert periodic_runs.collapse(docs.where("1 = 0")).collect() == []
    assert periodic_runs.repeat_tails(docs.where("1 = 0")).collect() == []


def plain_edit(key, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query_against_every_period(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op12_periodic_runs(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        words = plain_edit(key, text)
        found = plain_runs(words) if len(words) < 1500 else listed(words)
        row = got[key]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()

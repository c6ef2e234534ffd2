"""Operators of the llm package against plain versions, and the cases that every one of them has to stand."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers
from xxhash import xxh3_64_intdigest

import corpus_pipeline
from tillwork.llm import (
    byte_bpe,
    cap_filters,
    chat_layouts,
    circulant_minhash,
    induced_sort,
    line_crf,
    packing,
    suffix_dedup,
    unigram_counts,
    weighted_sampling,
    zstd_toxicity,
)
from tillwork.llm.common import mix64, prepare, stage
from tillwork.llm.components import components
from tillwork.llm.queries import PACKING, PIECES, RANKS

PATTERN = public_tokenizers.PATTERN
LONG = " ".join(f"word{i % 97}x{i}" for i in range(3000))
SHARED = "A passage that several documents share, long enough to be found by its bytes. " * 4
#: Null, empty and long texts, repeated rows, null ids, characters of several bytes.
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n "),
    (4, LONG),
    (4, LONG),
    (5, LONG + " tail"),
    (6, "one two"),
    (7, "ONE two"),
    (None, "one two"),
    (8, "naïve 😀 text   end  "),
    (9, "first " + SHARED + "unique ending number nine é"),
    (10, "second " + SHARED + "another ending for ten"),
    (11, "<|endoftext|> and  two spaces\n\n there"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows above, with a column whose name clashes with what operators make."""
    prepare(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumn("digest", F.lit("x")).withColumn("row", F.lit(1)).withColumn("score", F.lit(2))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def text(t):
    return t or ""


def test_suffixes_against_sorting():
    rng = np.random.default_rng(1)
    for n, symbols, memory, recursive in ((1, 1, 1, 1), (80, 2, 1, 1), (120, 3, 1 << 20, 1), (150, 1, 50, 9), (200, 9, 1, 1 << 20)):
        t = rng.integers(1, symbols + 1, n).astype(np.uint16)
        blocks = list(induced_sort.sorted_suffixes(t, 500, recursive, None, memory))
        found = np.concatenate([s for s, _ in blocks])[::-1].tolist()
        ends = [*t.tolist(), 0]
        assert found == sorted(range(n + 1), key=lambda i: ends[i:])
        common = np.concatenate([c for _, c in blocks])[1:][::-1].tolist()
        for a, b, c in zip(found, found[1:], common, strict=False):
            own = next(k for k in range(n + 2) if ends[a + k : a + k + 1] != ends[b + k : b + k + 1] or a + k > n or b + k > n)
            assert own == c


def plain_removal(texts):
    raws = [text(t).encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("crowd", [1000, 1])
def test_repeated_passages(docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    got = suffix_dedup.remove_repeats(docs).collect()
    want = sorted((str(i), len(text(t).encode()), k) for (i, t), k in zip(ROWS, plain_removal([t for _, t in ROWS]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept_bytes)) for r in got) == want
    assert all(r.n_removed == r.n_bytes - len(r.kept_bytes) for r in got)
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_many_rows_with_one_id_and_text(spark):
    """The work grows with the rows, not with their square: each row's hits are gathered once."""
    prepare(spark)
    text = " ".join(f"w{i * i}" for i in range(350))
    docs = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = suffix_dedup.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n")).count().collect()
    assert [tuple(r) for r in got] == [(5, len(text), len(text), 1, 2000)]


def test_segments_that_come_often_are_made_once():
    """Rare segments push out each other, not those that are asked for all the time."""
    made = Counter()

    def encode(segment):
        made[segment] += 1
        return [len(segment), 1 << 31]

    segments = byte_bpe.Segments(encode, 10)
    for i in range(500):
        assert segments.text(f"a often r{i}") == np.array([1, 1 << 31, 6, 1 << 31, len(f" r{i}"), 1 << 31], "<u4").tobytes()
    assert made[" often"] == 1 and len(segments) <= 10 and len(segments.older) <= 10


def test_line_ends_are_encoded_from_the_ranks():
    """A segment with a line end inside is plain; what is plain has the ids of the tokenizers library."""
    tokenizer = Tokenizer.from_file(PACKING[0])
    segments = packing.token_segments(*PACKING)
    assert packing._PLAIN("end.\nNext") and not any(map(packing._PLAIN, "\r\t\x1c\x85\xa0\xadɐ–"))
    rng = np.random.default_rng(3)
    plain = [c for c in map(chr, range(0x250)) if packing._PLAIN(c)]
    pool = plain + ["\n", " ", "'"] * 60 + list("end.Next, Àé1")
    for n in rng.integers(0, 20, 3000):
        t = "".join(rng.choice(pool, n))
        assert np.frombuffer(segments.text(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_a_line_that_every_text_repeats(spark):
    """A context is one row for each text that holds it, however often: joins grow with the texts, not with the places."""
    prepare(spark)
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = noise(300)
    texts = [noise(260) + line * (i % 7 + 30) + noise(230) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    rows = docs.mapInArrow(suffix_dedup._anchor_rows, suffix_dedup._ROWS_SQL)
    held = rows.groupBy("doc_id", "anchor", "digest").count()
    assert rows.count() == held.count() < 12 * 40
    assert rows.agg(F.max(F.size("again"))).first()[0] >= 34
    got = suffix_dedup.remove_repeats(docs).collect()
    assert [bytes(r.kept_bytes) for r in sorted(got, key=lambda r: r.doc_id)] == plain_removal(texts)


def test_only_windows_that_others_may_have_are_sorted():
    """Contexts of one anchor that agree around it only are left out; those that share windows keep these."""
    rng = np.random.default_rng(9)
    raw = lambda n: rng.integers(0, 256, n, np.uint8).tobytes()
    gram, before, after = raw(40), raw(160), raw(160)
    # A context has 161 windows here and its anchor 160 bytes after its first one; the last two share 30 bytes before and 240 after.
    near = raw(130) + before[-30:] + gram + after
    parts = [raw(160) + gram + raw(160), before + gram + after, near]
    n, left = np.full(3, 161), np.full(3, 160)
    begin, stop = suffix_dedup.shared_windows(parts, np.full(3, 5), n, left)
    found = suffix_dedup.repeated_windows(parts, n, np.ones(3, int))
    starts = [0, 361, 722]
    marked = [np.flatnonzero(found[s : s + 161]) for s in starts]
    assert begin[0] == stop[0] and not len(marked[0])
    for k in (1, 2):
        assert begin[k] <= marked[k].min() and marked[k].max() < stop[k] and stop[k] - begin[k] < len(marked[k]) + 2 * suffix_dedup.NEAR
    assert suffix_dedup.shared_windows(parts, np.arange(3), n, left)[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("crowd", [1000, 1])
def test_a_passage_in_many_places(spark, crowd, monkeypatch):
    """Parts of one passage, of any length, between texts that differ: every window is judged alone."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdé "))

    def noise(n):
        return "".join(rng.choice(letters, n))

    passage, texts = noise(700), []
    for i in range(40):
        a, b = sorted(rng.integers(0, 700, 2).tolist())
        texts.append(noise(int(rng.integers(0, 60))) + passage[a:b] + noise(int(rng.integers(0, 60))) + passage[: i * 9])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [bytes(r.kept_bytes) for r in sorted(got, key=lambda r: r.doc_id)] == plain_removal(texts)


def test_near_duplicates(docs, none):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in circulant_minhash.near_duplicates(docs).collect())
    least = {4: 4, 5: 4, 6: 6, 7: 6, None: 6, 1: 1, 2: 2, 3: 3}
    for i, n, component, kept in got:
        key = None if i == "None" else int(i)
        assert component == least.get(key, key) and kept == (component == key)
        assert (n == 0) == (key in (1, 2, 3))
    assert circulant_minhash.near_duplicates(none).collect() == []
    left = circulant_minhash.survivors(docs)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 8, 9, 10, 11] and left.columns == docs.columns


def plain_shingles(t):
    words = text(t).lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """The least id that each row is linked with, by Jaccard of all pairs."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    return {i: min(j for k, (j, _) in enumerate(rows) if find(k) == find(own)) for own, (i, _) in enumerate(rows)}


def near_rows():
    """Pairs just above and just below 0.75, chains, and a group whose members share many bands."""
    rng = np.random.default_rng(11)
    fresh = iter(range(10**9))

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    texts = []
    for n in (60, 100, 200):
        for k in range(n // 10, n // 5):  # k new words at the end change k shingles
            base = words(n)
            texts += [base, base[: n - k] + words(k)]
    chain = words(200)
    for _ in range(12):
        texts.append(chain)
        chain = chain[12:] + words(12)
    hot = words(120)
    for _ in range(40):
        own = list(hot)
        for at in rng.integers(0, 120, int(rng.integers(0, 7))).tolist():
            own[at] = words(1)[0]
        texts.append(own)
    order = rng.permutation(len(texts)).tolist()
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("leaders", [8, 0])
def test_near_duplicates_against_all_pairs(spark, leaders, monkeypatch):
    """Without leaders, the second round has to find every link."""
    monkeypatch.setattr(circulant_minhash, "LEADERS", leaders)
    prepare(spark)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in circulant_minhash.near_duplicates(df).collect()}
    want = plain_components(rows)
    assert got == want and 20 < len(set(want.values())) < len(rows) - 20


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_encoding_round_trip(docs, none):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS), special_tokens={})
    want = sorted((str(i), np.array(encoding.encode_ordinary(text(t)), "<u4").tobytes(), text(t).encode()) for i, t in ROWS)
    for chunk, overlap in ((byte_bpe.CHUNK, byte_bpe.OVERLAP), (50, 9), (9, 1)):
        got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN, chunk, overlap), RANKS).collect()
        assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.raw)) for r in got) == want
    assert byte_bpe.encode(none, RANKS, PATTERN).collect() == []


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(PACKING[0])
    want = Counter((str(i), len(tokenizer.encode(text(t), add_special_tokens=False).ids) + 1) for i, t in ROWS)
    rows = packing.pack(docs, PACKING).collect()
    assert Counter((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == want
    ids = {i: np.array(tokenizer.encode(text(t), add_special_tokens=False).ids + [1], "<u4") for i, t in ROWS}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= packing.SEQUENCE and sum(by.values()) == sum(n for (_, n), c in want.items() for _ in range(c))
    assert packing.pack(none, PACKING).collect() == []


def test_patterns_use_up_all_pieces_and_little_room():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 257, 5000), minlength=257)
    used, sequences = np.zeros(257, int), 0
    for pattern, often in packing.plan(counts, 256):
        assert sum(c * n for c, n in pattern.items()) <= 256
        sequences += often
        for c, n in pattern.items():
            used[c] += n * often
    assert (used == counts).all() and sequences <= 1.02 * (np.arange(257) @ counts) / 256 + 1


def test_token_counts(docs, none):
    model = Tokenizer(models.Unigram(unigram_counts.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = sorted((str(i), len(model.encode(text(t), add_special_tokens=False).ids)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in unigram_counts.token_counts(docs, PIECES).collect()) == want
    assert unigram_counts.token_counts(none, PIECES).collect() == []


def test_fingerprints(docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = weighted_sampling.fingerprints(docs).collect()
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        changed = weighted_sampling.edited(text(t), text(after))
        want[str(i), len(text(t)), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id in (6, 7, None)}) == 1
    assert weighted_sampling.fingerprints(none).collect() == []


def plain_sample(weights: Counter) -> np.ndarray:
    """Term by term, without a cache, in the formulas of the module's text."""
    out = np.zeros(weighted_sampling.COORDINATES, np.uint16)
    best = [(math.inf, 0, 0)] * len(out)
    for term, weight in weights.items():
        seed = xxh3_64_intdigest(term)
        made = np.empty((4, 1, len(out)), np.float32)
        weighted_sampling.variables(np.array([seed], np.uint64), made)
        r, b, c, at_one = made[:, 0]
        t = np.floor(np.log(np.float32(weight)) / r + b)
        value = at_one if weight == 1 else c - r * (t - b) - r
        best = [min(x, (float(v), seed, int(k))) for x, v, k in zip(best, value, t, strict=True)]
    if weights:
        seeds, scales = np.array([x[1] for x in best], np.uint64), np.array([x[2] for x in best]).astype(np.uint64)
        mixed = mix64(seeds + scales * np.uint64(0x9E3779B97F4A7C15) + weighted_sampling._SPREAD)
        out = (mixed >> np.uint64(48)).astype(np.uint16)
    return out


def test_fingerprints_over_several_tasks_are_plain_samples(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 500)) for i in range(300)] + [(300, None), (301, "")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r for r in weighted_sampling.fingerprints(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        changed = weighted_sampling.edited(text(t), text(after))
        own, other, following = (plain_sample(weighted_sampling.terms(text(x))) for x in (t, changed, after))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), other.tobytes().hex())
        assert (r.near_edited, r.near_next) == ((own == other).mean(), (own == following).mean())
    assert len(got) == len(rows)


def test_samples_do_not_depend_on_what_is_remembered():
    rng = np.random.default_rng(9)
    sampler = weighted_sampling.Sampler(256)
    for _ in range(60):
        a = Counter(b"w%d" % x for x in rng.zipf(1.2, 90) % 1000)
        b = Counter(b"w%d" % x for x in rng.zipf(1.2, 90) % 1000) + Counter(list(a)[:20])
        got = sampler.sample_both(a, b)
        assert (got[0] == plain_sample(a)).all() and (got[1] == plain_sample(b)).all()


def test_collisions_are_generalised_jaccard():
    a = Counter({b"w%d" % i: 1 + i % 5 for i in range(200)})
    b = Counter({b"w%d" % i: 1 + i % 3 for i in range(50, 260)})
    true = sum((a & b).values()) / sum((a | b).values())
    sampler = weighted_sampling.Sampler(64)
    found = weighted_sampling.likeness(sampler.sample(a), weighted_sampling.Sampler().sample(b))
    assert abs(found - true) < 4 * math.sqrt(true * (1 - true) / weighted_sampling.COORDINATES)


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 20] + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(200)]
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0)]
    rows += [(304, rows[0][1], None), (305, [], 0), (306, [1.0, None], 0), (None, rows[1][1], 1)]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    units = [None if lab is None else cap_filters.unit(v) if v else None for _, v, lab in rows]
    n, links = len(rows), Counter()
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and units[a] @ units[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((str(i), links[k], least.get(find(k))) for k, (i, *_) in enumerate(rows))
    assert Counter((str(r.vec_id), r.n_links, r.component_id) for r in got) == want


def labelled(spark, good, bad, column):
    texts = [(i, good(i) if i % 2 else bad(i)) for i in range(400)]
    labels = [(i, int(i % 2)) for i in range(400)] + [(None, 1), (999, None), (1000, 1)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {column} int")


def accuracy(scored):
    rows = [r for r in scored.collect() if r.held_out]
    assert len(rows) > 40 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == r.doc_id % 2 for r in rows])


def test_quality_model(spark, docs, none):
    texts, labels = labelled(
        spark, lambda i: f"A plain sentence number {i} stands here.\nIt has a second line too.", lambda i: f"Some words.\n$$$ ### {i} $$$ %%% ***\nmore", "quality"
    )
    model = line_crf.fit(texts, labels)
    assert accuracy(line_crf.score(texts, model)) > 0.95
    assert line_crf.score(docs, model).count() == len(ROWS) and line_crf.score(none, model).collect() == []
    assert {r.score for r in line_crf.score(texts, line_crf.fit(texts, labels.where("1 = 0"))).collect()} == {0.5}


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    model = line_crf.Model(np.zeros(1), rng.standard_normal(2), rng.standard_normal((2, 2)))
    scores, sizes = rng.standard_normal(7), np.array([4, 1, 2])
    good, _ = line_crf.marginals(model, scores, sizes)
    at = 0
    for n in sizes.tolist():
        weights, own = [], np.zeros(n)
        for path in range(1 << n):
            y = [path >> k & 1 for k in range(n)]
            w = math.exp(model.start[y[0]] + sum(scores[at + k] * y[k] for k in range(n)) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            weights.append(w)
            own += w * np.array(y)
        assert np.allclose(own / sum(weights), good[at : at + n])
        at += n


def test_toxicity_model(spark, docs, none):
    toxic = ["idiot", "worthless", "disgusting"]
    texts, labels = labelled(
        spark,
        lambda i: " ".join([f"tree{i % 7}", "river", toxic[i % 3], "stone", toxic[(i + 1) % 3], f"cloud{i % 11}"]),
        lambda i: " ".join([f"tree{i % 7}", "river", "water", "stone", "meadow", f"cloud{i % 11}"]),
        "toxic",
    )
    model = zstd_toxicity.fit(texts, labels)
    assert accuracy(zstd_toxicity.score(texts, model)) > 0.95
    assert zstd_toxicity.score(docs, model).count() == len(ROWS) and zstd_toxicity.score(none, model).collect() == []


def test_ordinary_dictionary_knows_whole_documents():
    """Ordinary documents open alike, and their own words come after 150 words."""
    rng = np.random.default_rng(4)
    bodies = [b"body%dword" % k for k in range(40)]
    opening = [b"opening%d" % k for k in range(150)]
    samples = [([*opening, *[bodies[k] for k in rng.integers(0, 40, 100)]], 0) for _ in range(60)]
    samples += [([bodies[k] for k in rng.integers(0, 40, 50)] + [b"idiot", b"worthless"] * 5, 1) for _ in range(60)]
    samples = [samples[k] for k in rng.permutation(120)]
    model = zstd_toxicity.train(samples)
    assert sum(w in model.ordinary for w in bodies) > 30 and sum(w in model.ordinary for w in opening) > 75


def test_calibration_sees_whole_texts(spark, monkeypatch):
    """Long documents have all their signs where samples of a few lines or words don't look."""
    monkeypatch.setattr(zstd_toxicity, "TRAIN_WORDS", 40)
    seen = {"lines": [], "words": []}
    texts, labels = labelled(
        spark, lambda i: f"A plain sentence number {i} stands here.\n" * 150, lambda i: f"$$$ ### {i} $$$\n" * 150, "quality"
    )
    for name, module in (("lines", line_crf), ("words", zstd_toxicity)):
        learn = module._logistic
        monkeypatch.setattr(module, "_logistic", lambda x, y, learn=learn, to=seen[name]: (to.append((x, y)), learn(x, y))[1])
    trained = texts.join(labels, "doc_id").where("doc_id is not null").collect()
    trained = [r for r in trained if zlib.crc32(str(r.doc_id).encode()) % 5]
    model = line_crf.fit(texts, labels)
    x, y = seen["lines"][0]
    own = line_crf.summaries(model, [r.text for r in trained])
    assert np.allclose(sorted(x[:, 0].tolist()), sorted(own[:, 0].tolist())) and len(x) == len(trained)
    assert np.allclose(sorted(x[:, 1].tolist()), sorted(own[:, 1].tolist()))
    toxic = labels.withColumnRenamed("quality", "toxic")
    zstd_toxicity.fit(texts, toxic)
    x, y = seen["words"][0]
    # The summary's last number but one is the logarithm of how many windows there are.
    counts = {round(math.log1p(len(zstd_toxicity.words(r.text))) / 8, 9) for r in trained}
    assert {round(v, 9) for v in x[:, -2].tolist()} == counts and {0, 1} == set(y.tolist())


def test_lines_are_learnt_in_runs():
    assert line_crf.runs(1) == [(0, 1)] and line_crf.runs(64) == [(0, 64)]
    for n in (65, 70, 100, 1000):
        own = line_crf.runs(n)
        assert own[0][0] == 0 and sum(own[-1]) == n and sum(k for _, k in own) <= line_crf.TRAIN_LINES
        assert all(a + k < b for (a, k), (b, _) in zip(own, own[1:], strict=False))
    model = line_crf.Model(np.zeros(1), np.array([0.0, 2.0]), np.zeros((2, 2)))
    within, _ = line_crf.marginals(model, np.zeros(4), np.array([2, 2]), opens=np.array([True, False]))
    assert np.allclose(within, [1 / (1 + math.exp(-2)), 0.5, 0.5, 0.5])


def test_chat_layouts(spark):
    tricky = ["\\### Assistant: </turn> ok", "a\\", "\n</turn>\n### user\nx", "", "😀 \\n"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "assistant", "a\\n\nb"], tricky, strict=True))]
    rows += [(2, None, None, None), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_layouts.format_records(chat_layouts.from_rows(table))
    read = out.select("conv_id", "layout", chat_layouts.read_turns(F.col("formatted")).alias("turns"), chat_layouts.read_loss(F.col("formatted"), F.col("loss")).alias("own"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.own) for r in read.collect()}
    assert got[1] == ([(r, t) for _, _, r, t in rows[:5]], tricky[2] + tricky[3])
    assert got[2] == ([("", "")], "") and got[None] == ([("user", "x")], "")
    assert chat_layouts.format_records(chat_layouts.from_rows(table.where("1 = 0"))).collect() == []


def test_other_layouts(spark):
    records = [
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", [("user", "q"), ("assistant", "a")]),
        ('{"instruction":"do","input":"this","output":"done"}', "instruction_input", [("user", "do\nthis"), ("assistant", "done")]),
        ('{"response":"r","prompt":"p"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"system":"s","prompt":"p","response":null}', "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
        ('{"other":1}', None, []),
    ]
    df = spark.createDataFrame([(r, i) for i, (r, _, _) in enumerate(records)], "json string, i int")
    out = chat_layouts.format_records(df.withColumn("record", F.parse_json("json")))
    for r in out.withColumn("turns", chat_layouts.read_turns(F.col("formatted"))).collect():
        assert (r.layout, [(t.role, t.text) for t in r.turns]) == records[r.i][1:]


def test_layouts_with_additional_paths(spark):
    """Paths that a mapping doesn't need cost no turn, and a record that fits none keeps its text."""
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        ('{"id":7,"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a"}]}', "messages", turns),
        ('{"meta":{"k":[1]},"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", turns),
        ('{"messages":[{"role":"user"},{"content":"a","x":null}]}', "messages", [("user", ""), ("", "a")]),
        ('{"messages":[]}', "messages", []),
        ('{"instruction":"do","input":"this","output":"done","id":1}', "instruction_input", [("user", "do\nthis"), ("assistant", "done")]),
        ('{"system":"s","prompt":"p","response":"r","id":1}', "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"question":"q","answer":"a","source":null}', "question_answer", turns),
        ('{"messages":["q",{"role":"assistant","content":"a"}],"id":1}', None, []),
        ('{"messages":[{"role":"user","content":[{"text":"q"}]}],"id":1}', None, []),
        ('{"messages":{"role":"user"}}', None, []),
        ('["\\n</turn>\\n"]', None, []),
        ('{"other":"text"}', None, []),
        (None, None, []),
    ]
    df = spark.createDataFrame([(r, i) for i, (r, _, _) in enumerate(records)], "json string, i int")
    out = chat_layouts.format_records(df.withColumn("record", F.parse_json("json")))
    rows = out.withColumn("turns", chat_layouts.read_turns(F.col("formatted"))).collect()
    assert len(rows) == len(records)
    for r in rows:
        assert (r.layout, [(t.role, t.text) for t in r.turns]) == records[r.i][1:], r.json
        if r.layout is None:
            assert json.loads(r.formatted or "null") == json.loads(r.json or "null") and r.loss == []


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the one before leaves, with the columns that it hands on; ``run`` ends where they do."""
    folder, columns = str(tmp_path), ["doc_id", "text", "lang", "source", "n_chars"]
    rows, labels = [], []
    for i in range(120):
        own = f"Plain words number {i} of é{i * 7} and {i * i} stand here in a sentence."
        if i % 4 == 0:
            own += f"\n$$$ ### {i} $$$ %%% ***"
        if i % 4 == 1:
            own += " idiot worthless disgusting" * 3
        if i % 10 == 2:
            own += " " + SHARED
        rows.append((i, own, "en", f"s{i % 3}", len(own)))
        labels.append((i, int(i % 4 != 0), int(i % 4 == 1)))
    rows += [(200, rows[3][1], "de", "x", 1), (201, None, None, "y", 0), (202, "", "fr", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    given = spark.read.parquet(f"{folder}/labels.parquet")

    def key(r):
        return tuple(r[c] for c in columns)

    docs = stage(prepare(spark).read.parquet(f"{folder}/documents.parquet"))
    for name, step in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        after = step(spark, docs, folder)
        if name == "quality":
            model = line_crf.fit(docs, given)
            want = [key(r) for r in before if line_crf.scores(model, [r.text])[0] >= 0.3]
        elif name == "toxicity":
            model = zstd_toxicity.fit(docs, given)
            want = [key(r) for r in before if zstd_toxicity.scores(model, [r.text])[0] < 0.5]
        elif name == "near_duplicates":
            root = plain_components([(r.doc_id, r.text) for r in before])
            want = [key(r) for r in before if root[r.doc_id] == r.doc_id]
        elif name == "repeated_passages":
            left = [b.decode("utf-8", "ignore") for b in plain_removal([r.text for r in before])]
            want = [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(before, left, strict=True)]
        else:
            break
        docs = stage(after)
        assert sorted((key(r) for r in docs.collect()), key=lambda r: r[0]) == want, name
        assert docs.columns == columns
        assert name == "repeated_passages" and want != [key(r) for r in before] or 0 < len(want) < len(before), name
    tokenizer = Tokenizer.from_file(PACKING[0])
    want = {r.doc_id: len(tokenizer.encode(text(r.text), add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, folder).collect()} == want

"""The conversation trie against plain dictionaries, SQL, and the cases that have to hold."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from tillwork.llm import prefix_trie
from tillwork.llm.common import prepare, table
from tillwork.llm.queries import SQL, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_sequences(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(text.encode()).digest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}


def plain_branches(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    rows, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * words
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        hashed = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        own = (min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashed)
        rows.append(own)
    return sorted(rows, key=str)


def made(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        length = rng.choice([1, 1, 2, 3, 5, 9])
        for turn in range(length):
            rows.append((c, turn, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "a", "b c", " x  y\x0b", None, ""])))
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [100_000, 40, 1])
def test_against_dictionaries(spark, most):
    prepare(spark)
    rows = made(random.Random(most), 120)
    convs = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    df = prefix_trie.trie(prefix_trie.branch_off(convs), most)
    assert sorted(df.columns) == sorted(COLUMNS)
    assert found(df) == plain_trie(plain_branches(plain_sequences(rows)))


def test_copies_common_turns_and_a_long_conversation(spark):
    """A third are copies, another third share their first 20 turns, and one goes on for 3,000 turns."""
    prepare(spark)
    rows = [(c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    rows += [(c, t, "user", f"shared words {t}" if t < 20 else f"own {c}") for c in range(60, 120) for t in range(22)]
    rows += [(500, t, "user", f"shared words {t}") for t in range(3000)]
    convs = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    want = plain_trie(plain_sequences(rows))
    for most in (50, 100_000):
        assert found(prefix_trie.trie(convs, most)) == want


def test_members_over_several_tasks(spark):
    members = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).cast("binary").alias("end_key"),
        (F.col("id") * 7919 % 3000 - 50).alias("conv_id"),
    )
    ids = {}
    for r in members.collect():
        ids.setdefault(bytes(r.end_key), []).append(r.conv_id)
    want = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}
    got = prefix_trie.member_hashes(members, part=100).collect()
    assert len(got) == len(want) and {bytes(r.end_key): r.ends_sha256 for r in got} == want


def test_double_array_has_its_sequences_and_no_others():
    rng = random.Random(4)
    known = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(0, 6))) for _ in range(500)})
    trie = prefix_trie.DoubleArray([list(x) for x in known])
    nodes = {x[:d] for x in known for d in range(len(x) + 1)}
    assert len(trie.states) == len(nodes) == len(set(trie.states))
    for x in {tuple(rng.randint(1, 41) for _ in range(3)) for _ in range(500)} | set(known):
        states = list(trie.walk(list(x)))
        assert len(states) - 1 == max(d for d in range(len(x) + 1) if x[:d] in nodes)
        assert [trie.depth[s] for s in states] == list(range(len(states)))


def test_nulls_ties_repeats_and_other_columns(spark):
    prepare(spark)
    rows = [
        (1, None, "user", "null first"),
        (1, 0, None, None),
        (1, 0, "", ""),
        (1, 1, "b", "tie"),
        (1, 1, "a", "tie"),
        (1, 1, "a", "also"),
        (2, 5, "user", "null first"),
        (2, 5, "user", "null first"),
        (None, 0, "user", "nobody's"),
        (-20, 0, "user", "below zero"),
        (3, 0, "user", "long " * 300_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("turns", F.lit("x")).withColumn("depth", F.lit(2))
    convs = prefix_trie.sequences(df)
    assert found(prefix_trie.trie(convs)) == plain_trie(plain_sequences(rows))
    assert prefix_trie.trie(prefix_trie.branch_off(prefix_trie.sequences(df.where("1 = 0")))).collect() == []
    alone = spark.createDataFrame([(7, 0, "user", "x")], SCHEMA)  # its own turns are cut away, and there is none to give some
    cut = prefix_trie.branch_off(prefix_trie.sequences(alone.withColumn("conv_id", F.lit(1).cast("long"))))
    assert found(prefix_trie.trie(cut)) == plain_trie(plain_branches({1: [("user", "x")]}))


def test_query_against_sql(spark, folder, con):
    assert difference(op11_prefix_trie(spark, folder), con, SQL["op11_prefix_trie"]) is None
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_prefix_trie(spark, folder)) == plain_trie(plain_branches(plain_sequences(rows)))

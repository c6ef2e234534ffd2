"""Tries of conversations in double arrays, one per shard of prefixes, merged where shards share their upper nodes.

A turn is known by the hash of its role and text, and a conversation by the chain of its turns' hashes, so equal
conversations are one sequence with a count. Sequences are dealt to shards by their first turn; a shard that would hold
too many turns is dealt anew by the first two turns, then four, and so on. A task numbers the turns of a shard densely,
packs the trie into a BASE and a CHECK array (the child of state ``s`` for turn ``c`` is ``BASE[s] + c``, and there CHECK
is ``s``), and walks it to count each node. Nodes below a shard's prefix lie in this shard alone. Those above it may lie
in several: their counts are merged by key, and sums over subtrees climb the merged nodes in steps of 1, 2, 4, ... levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import stage
from tillwork.operators.skew import own_shuffle

#: Turns of the sequences of a shard beyond which it is dealt by longer prefixes. One sequence is never cut.
SHARD_TURNS = 100_000
#: Ids in a part of a list of members.
PART = 1 << 16
#: Free places that are tried for a state's children before they go behind all others.
TRIES = 64

#: The root's key, and the hash of no members.
ROOT, NOBODY = b"", hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODES = pa.schema(
    [
        ("shared", pa.bool_()),
        ("key", pa.binary()),
        ("above", pa.list_(pa.binary())),
        ("parent", pa.binary()),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("words", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("end_key", pa.binary()),
    ]
)
_NODES = (
    "shared boolean, key binary, above array<binary>, parent binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, words long, n_children long, n_leaves long, saved_tokens long, end_key binary"
)


# ------------------------------------------------------------------ sequences


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``rows(conv_id, turn, role, text)``; a turn has the hash of its role and text, and its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.unhex(F.sha2(text, 256)).alias("text"),
            F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("turn"),
    )
    ordered = known.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")
    )


def branch_off(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, turns`` in which conversation ``c`` begins with the first turns of conversation ``c - c % every``.

    That many are taken: the CRC-32 of the id's decimal text, modulo ``most``. The conversation's own turns follow, but
    for as many at their beginning. A conversation that isn't there has no turns to give.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    first = convs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first")
    )
    own = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    return own.join(first, "base", "left").select(
        "conv_id",
        F.expr("concat(coalesce(slice(first, 1, h), slice(turns, 1, 0)), slice(turns, h + 1, size(turns)))").alias("turns"),
    )


def _chain(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(ROOT), lambda key, t: F.unhex(F.sha2(F.concat(key, t["key"]), 256)))


def _deal(distinct: DataFrame, most: int) -> DataFrame:
    """The sequences with their ``shard`` and ``cut``: nodes of a depth below ``cut`` may lie in other shards, too."""
    settled, open_, depth = None, distinct, 1
    while True:
        length = F.size("turns")
        keyed = open_.withColumn("shard", _chain(F.slice("turns", 1, depth))).withColumn(
            "cut", F.least(F.lit(depth), length + 1)
        )
        crowded = stage(
            keyed.where(length >= depth)
            .groupBy("shard")
            .agg(F.sum(length).alias("held"), F.count("*").alias("n"))
            .where((F.col("held") > most) & (F.col("n") > 1))
            .select("shard")
        )
        if crowded.isEmpty():
            return keyed if settled is None else settled.unionByName(keyed)
        done = keyed.join(own_shuffle(crowded), "shard", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        open_ = stage(keyed.join(own_shuffle(crowded), "shard", "left_semi").drop("shard", "cut"))
        depth *= 2


# ----------------------------------------------------------------------- trie


class DoubleArray:
    """A trie over sequences of numbers from 1 on. ``sequences`` are sorted and distinct; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check = [0], [-1]
        #: States from the root down, and the depth of each.
        self.states, self.depth = [0], {0: 0}
        self._free = 1
        todo = [(0, 0, len(sequences))]
        while todo:
            state, first, last = todo.pop()
            depth = self.depth[state]
            codes, starts = [], []
            for i in range(first, last):
                if len(sequences[i]) > depth and (not codes or sequences[i][depth] != codes[-1]):
                    codes.append(sequences[i][depth])
                    starts.append(i)
            if not codes:
                continue
            base = self.base[state] = self._place(codes)
            for code, begin, end in zip(codes, starts, [*starts[1:], last], strict=True):
                child = base + code
                self.check[child] = state
                self.depth[child] = depth + 1
                self.states.append(child)
                todo.append((child, begin, end))

    def _place(self, codes: list[int]) -> int:
        """A base at which the places of all ``codes`` are free. The arrays grow up to the last of them."""
        check = self.check
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        place, end = self._free, len(check)
        for _ in range(TRIES):
            while place < end and check[place] >= 0:
                place += 1
            base = place - codes[0]
            if base >= 0 and all(base + c >= end or check[base + c] < 0 for c in codes):
                break
            place += 1
        else:
            base = max(end - codes[0], 0)
        missing = base + codes[-1] + 1 - end
        if missing > 0:
            check.extend([-1] * missing)
            self.base.extend([0] * missing)
        return base

    def walk(self, sequence: list[int]) -> Iterator[int]:
        """The states that ``sequence`` goes through, as far as the trie has it."""
        state = 0
        yield state
        for code in sequence:
            child = self.base[state] + code
            if child >= len(self.check) or self.check[child] != state:
                return
            state = child
            yield state


def _count(rows: list[dict]) -> pa.RecordBatch:
    """Nodes of the trie over the rows of some shards."""
    codes: dict[bytes, int] = {}
    for row in rows:
        row["codes"] = [codes.setdefault(t["key"], len(codes) + 1) for t in row["turns"]]
    rows.sort(key=lambda row: row["codes"])
    trie = DoubleArray([row["codes"] for row in rows])
    n, least, words, ends, shared, key = {}, {}, {0: 0}, {}, {}, {0: ROOT}
    for row in rows:
        state = 0
        for depth, state in enumerate(trie.walk(row["codes"])):
            n[state] = n.get(state, 0) + row["n"]
            least[state] = min(least.get(state, row["conv_id"]), row["conv_id"])
            if depth < row["cut"]:
                shared[state] = True
            if depth and state not in words:
                turn = row["turns"][depth - 1]
                words[state] = turn["words"]
                if depth < row["cut"]:
                    key[state] = hashlib.sha256(key[trie.check[state]] + turn["key"]).digest()
        ends[state] = row["end_key"]
    children, leaves, saved = {}, {}, {}
    for state in sorted(trie.states, key=trie.depth.__getitem__, reverse=True):
        parent = trie.check[state]
        if state not in shared:
            leaves[state] = leaves.get(state, 0) or 1
            saved[state] = saved.get(state, 0) + (n[state] - 1) * words[state]
            children[parent] = children.get(parent, 0) + 1
            leaves[parent] = leaves.get(parent, 0) + leaves[state]
            saved[parent] = saved.get(parent, 0) + saved[state]
    out: dict[str, list] = {name: [] for name in NODES.names}
    for state in trie.states:
        parent, own = trie.check[state], state in shared
        path = []
        if own and parent >= 0:  # the nodes 1, 2, 4, ... levels above
            step, at, far = 1, parent, 1
            while True:
                if far == step:
                    path.append(key[at])
                    step *= 2
                at, far = trie.check[at], far + 1
                if at < 0:
                    break
        out["shared"].append(own)
        out["key"].append(key[state] if own else None)
        out["above"].append(path if own else None)
        out["parent"].append(key[parent] if not own and parent in shared else None)
        out["depth"].append(trie.depth[state])
        out["conv_id"].append(least[state])
        out["parent_conv_id"].append(None if own or parent in shared else least[parent])
        out["n_convs"].append(n[state])
        out["words"].append(words[state])
        out["n_children"].append(children.get(state, 0))
        out["n_leaves"].append(leaves.get(state, 0))
        out["saved_tokens"].append(saved.get(state, 0))
        out["end_key"].append(ends.get(state))
    return pa.RecordBatch.from_pydict(out, schema=NODES)


def _shard_rows(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Shards come one after the other; small ones share a trie. A shard is whole before it is counted."""
    held, turns, shard = [], 0, None
    for batch in rows:
        for row in batch.to_pylist():
            if row["shard"] != shard and turns > most // 4:
                yield _count(held)
                held, turns = [], 0
            shard = row["shard"]
            turns += 1 + len(row["turns"])
            held.append(row)
    if held:
        yield _count(held)


# --------------------------------------------------------------------- merging


def _merge(nodes: DataFrame) -> DataFrame:
    """Shared nodes of all shards by key, with their numbers of children, leaves and saved tokens below."""
    upper = stage(
        nodes.where("shared")
        .groupBy("key")
        .agg(
            F.first("above").alias("above"),
            F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.first("words").alias("words"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.max("end_key").alias("end_key"),
        )
    )
    below = upper.where("depth > 0").groupBy(F.get("above", F.lit(0)).alias("key")).agg(F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    current = (
        upper.join(below, "key", "left")
        .withColumn("n_children", children)
        .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
        .drop("more")
    )
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    step = 0
    while 1 << step <= deepest:
        current = stage(current)
        sent = (
            current.where(F.size("above") > step)
            .groupBy(F.get("above", F.lit(step)).alias("key"))
            .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        )
        current = (
            current.join(sent, "key", "left")
            .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)))
            .drop("more_leaves", "more_saved")
        )
        step += 1
    return stage(current)


def _part_rows(rows: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Sorted members, joined by commas in parts of ``part`` ids at most."""
    key, ids, out = None, [], []

    def done() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)],
                               names=["end_key", "first", "ids"])

    for batch in rows:
        for end, conv in zip(batch["end_key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (end != key or len(ids) >= part):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = end
            ids.append(conv)
        if out:
            yield done()
            out = []
    if ids:
        out.append((key, ids[0], ",".join(map(str, ids))))
        yield done()


def _hash_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's parts, which come in order. Only the hash's state is held."""
    key, state = None, None
    for batch in rows:
        keys, hashes = [], []
        for end, ids in zip(batch["end_key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if state is not None and end == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                keys.append(key)
                hashes.append(state.hexdigest())
            key, state = end, hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["end_key", "ends_sha256"])
    if state is not None:
        yield pa.record_batch(
            [pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["end_key", "ends_sha256"]
        )


def member_hashes(members: DataFrame, part: int = PART) -> DataFrame:
    """``end_key, ends_sha256`` of ``members(end_key, conv_id)``: ids in order, joined by commas, hashed.

    The members of one key are sorted over several tasks, which join them into parts. Hashing goes from part to part.
    """
    parts = (
        members.select("end_key", "conv_id")
        .repartitionByRange("end_key", "conv_id")
        .sortWithinPartitions("end_key", "conv_id")
        .mapInArrow(partial(_part_rows, part=part), "end_key binary, first long, ids string")
    )
    return (
        parts.repartition("end_key")
        .sortWithinPartitions("end_key", "first")
        .mapInArrow(_hash_rows, "end_key binary, ends_sha256 string")
    )


def trie(convs: DataFrame, most: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie over ``convs(conv_id, turns)`` as :func:`sequences` makes them.

    Per node: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, the words of a node's last turn times one less than
    its members) and ``ends_sha256`` (of the ids of members that end here). A null role or text is the empty one. Rows
    come in the order of their turn number, null first; equal numbers by role and then by the text's hash, so repeated
    rows are repeated turns. Rows without a ``conv_id`` belong to no conversation. A conversation is one row of hashes
    and word counts, whatever the length of its texts. An empty table has no nodes, not even the root.
    """
    chained = stage(convs.withColumn("end_key", _chain(F.col("turns"))))
    distinct = stage(
        chained.groupBy("end_key").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
        )
    )
    nodes = stage(
        _deal(distinct, most)
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(partial(_shard_rows, most=most), _NODES)
    )
    upper = _merge(nodes)
    counts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]
    parents = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    merged = upper.withColumn("parent", F.get("above", F.lit(0)))
    below = nodes.where("not shared and parent is not null").drop("parent_conv_id")
    hanging = merged.where("depth > 0").select("parent", *[c for c in counts if c != "parent_conv_id"])
    hanging = hanging.unionByName(below.select(*hanging.columns)).join(parents, "parent")
    root = merged.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = (
        nodes.where("not shared and parent is null")
        .select(*counts)
        .unionByName(hanging.select(*counts))
        .unionByName(root.select(*counts))
    )
    ends = every.where("end_key is not null").join(member_hashes(chained), "end_key")
    rest = every.where("end_key is null").withColumn("ends_sha256", F.lit(NOBODY))
    return ends.unionByName(rest).drop("end_key")


#: The nodes of conversations rebuilt by :func:`branch_off`, in DuckDB's SQL. CRC-32 is worked out bit by bit.
SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id,
        list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(text)) AS turns,
        xor(list_reduce(
            [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
            lambda crc, byte: list_reduce(
                [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT o.conv_id, coalesce(b.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), members AS (
    SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), placed AS (
    SELECT conv_id, depth, depth = len(turns) AS ends,
        sha256(CASE WHEN depth = 0 THEN '' ELSE to_json(turns[1:depth])::VARCHAR END) AS key,
        CASE WHEN depth > 0 THEN sha256(CASE WHEN depth = 1 THEN '' ELSE to_json(turns[1:depth - 1])::VARCHAR END) END AS parent,
        CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
    FROM members
), nodes AS (
    SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
    FROM placed GROUP BY key, depth
), counted AS (
    SELECT n.key, n.depth, n.conv_id, n.n_convs, n.words, n.ends, p.conv_id AS parent_conv_id,
        (SELECT count(*) FROM nodes c WHERE c.parent = n.key AND c.depth = n.depth + 1) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1
), above AS (
    SELECT DISTINCT a.key AS key, a.depth AS depth, d.key AS below, d.depth AS below_depth
    FROM placed d JOIN placed a ON a.conv_id = d.conv_id AND a.depth <= d.depth
), summed AS (
    SELECT a.key, a.depth, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
        sum((d.n_convs - 1) * d.words) AS saved_tokens
    FROM above a JOIN counted d ON d.key = a.below AND d.depth = a.below_depth GROUP BY a.key, a.depth
)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs::BIGINT AS n_convs,
    c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
    sha256(c.ends) AS ends_sha256
FROM counted c JOIN summed s ON s.key = c.key AND s.depth = c.depth
"""

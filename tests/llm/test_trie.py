"""Conversation trie against a plain one."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from stockops.llm import conversation_trie as ct

CONV = "conv_id long, turn long, role string, text string"


def plain_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # towards zero, as in SQL
        head = [x[2:] for x in sorted(own.get(base, []))][:h]
        seqs[c] = head + [x[2:] for x in sorted(own[c])][h:]
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, **options):
    d = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("x") for c in ("depth", "s1", "pos", "k", "length", "parent", "h", "base")})
    got = ct.conversation_nodes(d, **options)
    assert sorted(got.columns) == sorted(COLUMNS)
    return [tuple(r[c] for c in COLUMNS) for r in got.collect()]


def test_trie_equals_plain_one(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 100, 101, 103, 205, 206, 207, -3, -150]:  # 205 to 207 have no beginning to share
        for t in range(rng.choice([0, 1, 2, 5, 9, 17])):
            rows.append((c, rng.choice([None, t]) if t < 2 else t, rng.choice(["user", None, "é"]), rng.choice(["a", "b", "", None, "ü𝄞"])))
    rows += [(400, t, "u", "same " * 3) for t in range(40)] + [(401, t, "u", "same " * 3) for t in range(33)]
    rows += [(None, 1, "u", "nobody's"), (500, None, None, None), (501, 3, "u", "long " * 20_000)] + [(600 + i, t, "u", f"{t}") for i in range(40) for t in range(12)]
    rows += [(700, 1, "u", "twice")] * 3
    want = plain_nodes(rows)
    for options in ({}, {"width": 2, "block": 5}, {"width": 3}):
        got = found(spark, rows, **options)
        assert len(got) == len(set(got)) and set(got) == want
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []


def test_chain_of_conversations(spark):
    """Each conversation goes one turn further than the one before: runs hang on runs, forty deep."""
    rows = [(1000 + c, t, "u", "x" * 2 if t < c else f"{c}") for c in range(40) for t in range(c + 1)]
    turns, convs = ct.numbered(spark.createDataFrame(rows, CONV)), None
    nodes, ends = ct.prefix_trie(turns, convs, width=4, block=30)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves) for r in nodes.collect()}
    assert got[1000, 0] == (None, 40, 2, 40) and got[1001, 1] == (1000, 39, 2, 39) and got[1039, 40] == (1039, 1, 0, 1)
    assert ends.count() == 40 and ct.id_digests(ends, chunk=7).count() == 40


def test_ends_of_a_hot_node(spark):
    ends = spark.range(20_000).select((F.col("id") * 3 - 500).alias("conv_id"), *[F.lit(1).cast("long").alias(c) for c in ct.NODE])
    want = hashlib.sha256(",".join(str(i * 3 - 500) for i in range(20_000)).encode()).hexdigest()
    for chunk in (1, 10, 4096):
        assert [r.ends_sha256 for r in ct.id_digests(ends, chunk).collect()] == [want]

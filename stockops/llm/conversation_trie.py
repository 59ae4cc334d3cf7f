"""Prefix trie of conversations: blocks of turns first, single turns where siblings diverge.

A turn has a 128-bit digest; a prefix has the exclusive-or of its turns' digests, each mixed with its
place, so prefixes of one long conversation are computed in ranges of it. Conversations are grouped by
the digests of successive blocks of turns. Where a prefix goes on with one block only, the turns inside
have the members of the block; where it forks, the distinct blocks (not the conversations) are laid out
turn by turn and grouped again.

Every conversation owns the nodes whose smallest member it is: a run of depths, that hangs on a node of
another one. Sums over subtrees are sums over this tree of runs, contracted by pointer jumping, and then
running sums from the end of each run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forest import contracted
from ..functions.scan import BLOCK, running
from ..functions.skew import lookup
from .common import durable, if_small, ship, written

ship(__name__)

NODE = ["depth", "s1", "s2"]


def numbered(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, pos (from 1), d1, d2 (digest of role and text), length.

    Turns are in order of turn, null first; equal turns by role and text. Null roles and texts are empty.
    Rows without conv_id belong to no conversation. ``length``: code points of the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("d1"), F.xxhash64(text, role, F.lit(7)).alias("d2"), F.length(text).cast("long").alias("length"), role.alias("role"), F.left(text, F.lit(64)).alias("start")
    )
    order = [F.col("turn").asc_nulls_first(), "role", "start", "d1", "d2"]
    return running(rows, ["conv_id"], order, {"pos": F.lit(1).cast("long")}, block=block).select("conv_id", "pos", "d1", "d2", "length")


def rebuilt(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (turns, conversations) of the same form.

    Conversation c begins with the first h turns of c - c % family (towards zero), h being crc32(c) % heads, and goes on
    with its own turns after its first h. A beginning that is absent or shorter gives what it has.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = turns.select("conv_id").distinct().withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    given = convs.join(first, "base").where("pos <= h").select("conv_id", "pos", "d1", "d2", "length")
    # conversations whose beginning is shorter than h close up the gap
    shift = convs.join(first.groupBy("base").agg(F.count(F.lit(1)).alias("n")), "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("gap")).where("gap > 0")
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).where("pos > h")
    own = own.join(if_small(shift, 16, 8 << 20), "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "d1", "d2", "length")
    return given.unionByName(own), convs.select("conv_id")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, d1, d2, length) -> conv_id, pos, s1, s2 (digest of the prefix), q1, q2 (of the one before), length."""
    x1, x2 = F.xxhash64("pos", "d1", "d2"), F.xxhash64(F.lit(1), "d2", "pos", "d1")
    rows = turns.select("conv_id", "pos", "length", x1.alias("x1"), x2.alias("x2"))
    rows = running(rows, ["conv_id"], ["pos"], {"s1": F.col("x1"), "s2": F.col("x2")}, block=block, fold="bit_xor")
    return rows.select("conv_id", "pos", "s1", "s2", F.col("s1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("s2").bitwiseXOR(F.col("x2")).alias("q2"), "length")


def levels(turns: DataFrame, width: int) -> DataFrame:
    """Nodes but the root: depth, s1, s2, q1, q2, length, n_convs, conv_id."""
    k = F.floor((F.col("pos") - 1) / width)
    item = F.struct("pos", "s1", "s2", "q1", "q2", "length")
    blocks = turns.groupBy("conv_id", k.alias("k")).agg(F.array_sort(F.collect_list(item)).alias("turns"))  # width turns at most
    begin, end = F.col("turns")[0], F.element_at("turns", -1)
    blocks = blocks.select("conv_id", "k", begin["q1"].alias("p1"), begin["q2"].alias("p2"), end["s1"].alias("e1"), end["s2"].alias("e2"), F.size("turns").alias("m"), "turns")
    blocks = blocks.groupBy("k", "p1", "p2", "e1", "e2", "m").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    blocks = written(blocks, "blocks")
    forks = blocks.groupBy("k", "p1", "p2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("k", "p1", "p2")
    alone, apart = (lookup(blocks, forks, ["k", "p1", "p2"], how).select("n", "conv_id", F.explode("turns").alias("t")).select("n", "conv_id", "t.*") for how in ("left_anti", "left_semi"))
    keys = [F.col("pos").alias("depth"), "s1", "s2", "q1", "q2", "length"]
    merged = apart.groupBy(*keys).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return alone.select(*keys, F.col("n").alias("n_convs"), "conv_id").unionByName(merged)


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, width: int = 8, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations and where each of them ends.

    turns: conv_id, pos (1, 2, ... in each conversation), d1, d2, length. ``convs``: conv_id of all
    conversations, those without turns included; else those of ``turns``. Nodes: conv_id (smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and the digest s1,
    s2. Ends: conv_id, depth, s1, s2, one row a conversation. Turnless conversations end at the root.
    Without conversations there is no root. Conversations of any length and nodes of any number of members
    are spread over tasks: only the ``width`` turns of one block ever meet in one row.
    """
    turns = written(prefixes(turns, block), "prefixes")
    convs = (turns if convs is None else convs).select("conv_id").distinct()
    last = turns.groupBy("conv_id").agg(F.max(F.struct("pos", "s1", "s2")).alias("e")).select("conv_id", F.col("e.pos").alias("depth"), "e.s1", "e.s2")
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE])
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), zero.alias("length"), "n_convs", "conv_id")
    nodes = written(levels(turns, width).unionByName(root), "nodes").withColumn("saved", (F.col("n_convs") - 1) * F.col("length"))

    # runs of nodes with one smallest member, and the node that each run hangs on
    runs = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "q1", "q2")).alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"))
    runs = durable(runs.select("conv_id", (F.col("top.depth") - 1).alias("depth"), F.col("top.q1").alias("s1"), F.col("top.q2").alias("s2"), "bottom", "saved"))
    owners = nodes.select(*NODE, F.col("conv_id").alias("parent"))
    hung = lookup(runs.where("depth >= 0"), owners, NODE).select("conv_id", "parent", "depth", "bottom", "saved")
    hung = durable(hung.unionByName(runs.where("depth < 0").select("conv_id", F.lit(None).cast("long").alias("parent"), "depth", "bottom", "saved")))
    below = hung.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_runs"))
    leaf = hung.alias("r").join(below.alias("b"), (F.col("r.conv_id") == F.col("b.conv_id")) & (F.col("r.bottom") == F.col("b.depth")), "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaves"))
    valued = hung.join(leaf, "conv_id", "left").select(F.col("conv_id").alias("id"), "parent", F.coalesce("leaves", zero).alias("leaves"), "saved")
    total = contracted(valued, ["leaves", "saved"]).select(F.col("id").alias("conv_id"), "leaves", "saved")
    hung = hung.select("conv_id", "parent", "depth").join(total, "conv_id")
    met = hung.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("leaves").alias("run_leaves"), F.sum("saved").alias("run_saved"))
    nodes = nodes.join(met, ["conv_id", "depth"], "left").fillna(0, ["n_runs", "run_leaves", "run_saved"])
    own = {"deeper": F.lit(1).cast("long"), "leaves_": F.col("run_leaves"), "saved_": F.col("run_saved") + F.col("saved")}
    nodes = running(nodes, ["conv_id"], [F.col("depth").desc()], own, block=block)
    # the run's last node is a leaf unless another run hangs on it
    ended = leaf.select("conv_id", F.col("leaves").alias("own_leaf"))
    tops = hung.select("conv_id", F.col("parent"), (F.col("depth") + 1).alias("top"))
    nodes = nodes.join(ended, "conv_id", "left").join(tops, "conv_id")
    nodes = nodes.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("n_runs") + (F.col("deeper") > 1).cast("long")).alias("n_children"),
        (F.col("leaves_") + F.coalesce("own_leaf", zero)).alias("n_leaves"),
        F.col("saved_").alias("saved_tokens"),
        "s1",
        "s2",
    )
    return nodes, ends


def id_digests(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """depth, s1, s2, ends_sha256: SHA-256 of the decimal ids that end at each node, ascending, joined by commas.

    Ids are joined in ranges of ``chunk`` first; a task then reads the strings of a node one after another
    and holds none but the last.
    """
    parts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / chunk).alias("part")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in found], pa.int64()) for i in range(3)] + [pa.array([s for _, s in found], pa.string())], [*NODE, "ends_sha256"])

        for batch in it:
            found = []
            for *at, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == at:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    found.append((key, sha.hexdigest()))
                key, sha = at, hashlib.sha256(ids.encode())
            yield out(found)
        if key is not None:
            yield out([(key, sha.hexdigest())])

    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids").mapInArrow(digests, "depth long, s1 long, s2 long, ends_sha256 string")


def with_end_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with the digest of the conversations that end there; the empty string's where none does."""
    return nodes.join(id_digests(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def conversation_nodes(conversations: DataFrame, family: int = 100, heads: int = 6, width: int = 8, block: int = BLOCK) -> DataFrame:
    """Trie of the rebuilt conversations, with end digests: the contract's columns."""
    turns, convs = rebuilt(durable(numbered(conversations, block)), family, heads)
    nodes, ends = prefix_trie(turns, durable(convs), width, block)
    return with_end_digests(nodes, ends).drop("s1", "s2")

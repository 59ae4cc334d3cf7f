"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one node. Lists of nearest neighbours start from vectors that fall on the same sides of
random planes. Then, round by round, every node brings its neighbours and those that list it together; each
pair that beats the worst entry of a list enters it, and only pairs with a fresh entry are tried. A list
that holds nothing but links of the threshold is saturated and grows, up to ``most`` entries. Rounds end
when links settle and an audit, which compares some vectors with all, finds the wanted share of
their links; until then further planes are drawn.

Sketches of half precision decide all but the pairs near the threshold, which are compared in doubles. Nodes
that fill even the largest list lie in crowds: within a crowd links are counted, not listed, block against
block in order of the angle to the crowd's mean, and by that angle alone where it settles whole blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import forget
from ..functions.scan import running
from ..functions.skew import lookup
from .common import connected_components, durable, ship, unite, written
from .jaccard import sorted_groups

ship(__name__)
ship("stockops.llm.common")
ship("stockops.llm.jaccard")

#: Greatest error of a cosine of two half-precision sketches, with room for sums in single precision.
SLACK = 0.0012

#: Rows of a group that are compared with each other at a time.
PIECE = 512


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def stacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, unit (doubles as bytes), h1, h2 of linkable vectors. Equal vectors have equal components; h1
    and h2 name them."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            units = []
            for v in b.column(1):
                v = v.values.to_numpy(zero_copy_only=False)
                v = v / np.abs(v).max()
                units.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(u) // 8 for u in units], pa.int32()), pa.array(units, pa.binary()), b.column(2), b.column(3)], ["vec_id", "dims", "unit", "h1", "h2"])

    return rows.select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(3), F.reverse("x")).alias("h2")).mapInArrow(batches, "vec_id long, dims int, unit binary, h1 long, h2 long")


def with_sketch(nodes: DataFrame) -> DataFrame:
    """Adds the half-precision sketch of ``unit``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sketch = pa.array([np.frombuffer(u, np.float64).astype(np.float16).tobytes() for u in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, sketch], [*b.schema.names, "sketch"])

    return nodes.select("node", "dims", "unit", "n", "least", "h1", "h2").mapInArrow(batches, "node long, dims int, unit binary, n long, least long, h1 long, h2 long, sketch binary")


def bucketed(nodes: DataFrame, tables: range, bits: int, seed: int) -> DataFrame:
    """(g1, g2, node, sketch): for each table the sides of ``bits`` random planes a node lies on."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for b in it:
            sketches, dims = b.column(2).to_pylist(), b.column(1).to_numpy()
            for d in np.unique(dims):
                here = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(sketches[i] for i in here), np.float16).reshape(len(here), d).astype(np.float32)
                for t in tables:
                    if (d, t) not in planes:
                        planes[d, t] = np.random.default_rng([seed, t, int(d)]).standard_normal((d, bits), np.float32)
                    side = ((x @ planes[d, t]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(here), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), t * 100_003 + int(d), np.int64)), pa.array(side), b.column(0).take(pa.array(here)), pa.array([sketches[i] for i in here], pa.binary())], ["g1", "g2", "node", "sketch"])

    return nodes.select("node", "dims", "sketch").mapInArrow(batches, "g1 long, g2 long, node long, sketch binary")


def dealt(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Groups (g1, g2) of more than ``piece`` rows are dealt out to several: g2 becomes a number of its own."""
    sizes = rows.groupBy("g1", "g2").agg(F.ceil(F.count(F.lit(1)) / piece).alias("_k")).where("_k > 1")
    part = F.pmod(F.xxhash64("node"), F.coalesce("_k", F.lit(1)))
    return lookup(rows, sizes, ["g1", "g2"], "left").withColumn("g2", F.xxhash64("g2", part)).drop("_k")


def compared(rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """(g1, g2, node, floor, fresh, sketch) -> (src, dst, sim, span): pairs of one group that beat the floor of src.

    Of two rows that are not fresh no pair is tried. Where a row has more links than a list may hold, the
    links of its group are also given as a spanning forest (``span``), so that no crowd falls apart.
    """

    def out(found):
        a, b, s, span = (np.concatenate(x) if x else np.zeros(0) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 4
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(np.float32)), pa.array(span.astype(bool))], ["src", "dst", "sim", "span"])

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for group in sorted_groups(it):
            node, floor, fresh = (group[c].to_numpy() for c in ("node", "floor", "fresh"))
            if not fresh.any():
                continue
            x = stacked(group["sketch"], np.float16).astype(np.float32)
            for part in np.array_split(np.arange(len(node)), -(-len(node) // PIECE)):
                sim = x[part] @ x[part].T
                new = fresh[part]
                sim[~(new[:, None] | new)] = -2
                np.fill_diagonal(sim, -2)
                beats = sim > floor[part][:, None]
                many = np.flatnonzero(beats.sum(1) > most)
                for i in many:
                    beats[i, np.argpartition(-sim[i], most)[most:]] = False
                i, j = np.nonzero(beats)
                ids = node[part]
                found.append((ids[i], ids[j], sim[i, j], np.zeros(len(i), bool)))
                full = np.flatnonzero((floor[part] >= threshold - SLACK) | ((sim >= threshold).sum(1) > most))
                if len(full):
                    a, b = np.nonzero(sim[full] >= threshold + SLACK)
                    root = unite(np.arange(len(part)), full[a], b)
                    tied = np.flatnonzero(root != np.arange(len(part)))
                    found.append((ids[tied], ids[root[tied]], np.ones(len(tied)), np.ones(len(tied), bool)))
                held += len(i)
            if held > 50_000:
                yield out(found)
                found, held = [], 0
        yield out(found)

    rows = rows.select("g1", "g2", "node", F.col("floor").cast("float").alias("floor"), "fresh", "sketch")
    return rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(pairs, "src long, dst long, sim float, span boolean")


def merged(lists: DataFrame | None, pairs: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """Lists (src, dst, sim, fresh) with the pairs that enter them: the ``least`` nearest, and all that may be
    links up to ``most``. Entries that were not there before are fresh."""
    new = pairs.where("not span").select("src", "dst", "sim", F.lit(True).alias("fresh"))
    both = new if lists is None else new.unionByName(lists.select("src", "dst", "sim", F.lit(False).alias("fresh")))
    both = both.repartition("src").groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    nearest = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    both = both.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= most)
    return both.where((F.col("rn") <= least) | (F.col("sim") >= threshold - SLACK)).drop("rn")


def floors(lists: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """(src, floor): what an entry must beat to enter a list. Saturated lists take every link until they hold ``most``."""
    low = lists.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst"))
    room = F.when(F.col("n") < least, F.lit(-2.0)).when((F.col("worst") >= threshold - SLACK) & (F.col("n") < most), threshold - SLACK - 1e-6)
    return low.select("src", F.coalesce(room, F.col("worst")).alias("floor"))


def joined_locally(nodes: DataFrame, lists: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """Pairs of neighbours of one node: its own entries, those that list it, and itself."""
    sites = lists.select(F.col("src").alias("g1"), F.col("dst").alias("node"), "fresh").union(lists.select(F.col("dst").alias("g1"), F.col("src").alias("node"), "fresh"))
    sites = sites.groupBy("node", "g1").agg(F.max("fresh").alias("fresh"))
    members = nodes.select("node", "sketch").join(floors(lists, threshold, least, most).withColumnRenamed("src", "node"), "node", "left").fillna(-2.0, ["floor"])
    met = sites.join(members, "node").select("g1", "node", "floor", "fresh", "sketch")
    met = met.unionByName(members.select(F.col("node").alias("g1"), "node", "floor", F.lit(False).alias("fresh"), "sketch"))
    return compared(met.withColumn("g2", F.lit(0).cast("long")), threshold, most)


def audited(nodes: DataFrame, links: DataFrame, full: DataFrame, threshold: float, probes: int) -> tuple[int, int]:
    """Links of some nodes, and how many of them were found. Probes are taken by hash among the nodes whose
    lists are not full (those are counted exactly); their number is fixed, so all nodes meet them by broadcast."""
    some = nodes.join(full.withColumnRenamed("src", "node"), "node", "left_anti").orderBy(F.xxhash64("node", F.lit(11))).select("node", "dims", "unit").limit(probes).collect()
    ids = {d: np.array([r.node for r in some if r.dims == d], np.int64) for d in {r.dims for r in some}}
    units = {d: np.array([np.frombuffer(r.unit, np.float64) for r in some if r.dims == d]) for d in ids}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            node, dims, unit = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for d in set(dims.tolist()) & set(ids):
                here = np.flatnonzero(dims == d)
                i, j = np.nonzero(np.frombuffer(b"".join(unit[k] for k in here), np.float64).reshape(len(here), d) @ units[d].T >= threshold)
                a, c = node[here[i]], ids[d][j]
                yield pa.RecordBatch.from_arrays([pa.array(c[a != c]), pa.array(a[a != c])], ["src", "dst"])

    true = durable(nodes.select("node", "dims", "unit").mapInArrow(batches, "src long, dst long"))
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return true.count(), true.join(both, ["src", "dst"], "left_semi").count()


def verified(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (src, dst) with src < dst whose cosine in doubles reaches the threshold."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("unit").alias(f"{name}_unit"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            a, c = ([np.frombuffer(u, np.float64) for u in b.column(i).to_pylist()] for i in (2, 3))
            good = pa.array([float(x @ y) >= threshold for x, y in zip(a, c, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(good)

    return pairs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_unit", "dst_unit").mapInArrow(batches, "src long, dst long")


def links_of(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Distinct links src < dst of the lists: sure ones by their sketches, others by doubles."""
    near = lists.where(F.col("sim") >= threshold - SLACK).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    sure = near.where(F.col("sim") >= threshold + SLACK).select("src", "dst")
    return sure.union(verified(nodes, near.where(F.col("sim") < threshold + SLACK), threshold))


def mean_directions(rows: DataFrame) -> DataFrame:
    """(crowd, dims, unit) -> (crowd, dims, mean): sums of unit vectors, added up in tasks first."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sums = {}
            for k, d, u in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                sums[k, d] = sums.get((k, d), 0.0) + np.frombuffer(u, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int64()), pa.array([d for _, d in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["crowd", "dims", "sums"])

    parts = rows.select("crowd", "dims", "unit").mapInArrow(batches, "crowd long, dims int, sums array<double>").select("crowd", "dims", F.posexplode("sums").alias("i", "s"))
    whole = parts.groupBy("crowd", "dims", "i").agg(F.sum("s").alias("s"))
    return whole.groupBy("crowd", "dims").agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("mean"))


def angles(rows: DataFrame) -> DataFrame:
    """(crowd, dims, node, n, unit, mean) -> the same with ``angle`` to the mean for ``mean``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for u, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                m, u = np.array(m), np.frombuffer(u, np.float64)
                size = math.sqrt(m @ m)
                out.append(math.acos(min(1.0, max(-1.0, float(u @ m) / size))) if size else math.pi)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.float64())], ["crowd", "dims", "node", "n", "unit", "angle"])

    return rows.select("crowd", "dims", "node", "n", "unit", "mean").mapInArrow(batches, "crowd long, dims int, node long, n long, unit binary, angle double")


def upto(blocks: DataFrame, key: list[str], place: Column, ask: Column, hot: int) -> DataFrame:
    """(key, blk, number, weight): how many blocks have their place at or before what each block asks for, and their w."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    gives = blocks.select(*key, F.lit(None).cast("long").alias("blk"), place.alias("at"), "w", one.alias("one"))
    asks = blocks.select(*key, "blk", ask.alias("at"), zero.alias("w"), zero.alias("one"))
    both = running(gives.unionByName(asks), key, ["at", F.col("blk").asc_nulls_first()], {"weight": F.col("w"), "number": F.col("one")}, block=hot)
    return both.where("blk is not null").select(*key, "blk", "number", "weight")


def counted(rows: DataFrame, threshold: float, block: int = 1024, hot: int = 1 << 20) -> DataFrame:
    """(crowd, dims, node, n, unit) -> (node, weight): rows (n each) of the same crowd that reach the threshold.

    Members of a crowd are cut into blocks in order of their angle to its mean. Two blocks whose greatest
    angles add up to no more than the threshold's angle are linked throughout; two that are further apart than
    it, nowhere. A block's linked blocks are a running sum, never a list, and only pairs between are compared.
    """
    key, unit = ["crowd", "dims"], 1 << 40  # angles as integers, so both blocks of a pair judge it alike
    within, beyond = int((math.acos(threshold) - 1e-7) * unit), int((math.acos(threshold) + 1e-7) * unit)
    placed = angles(lookup(rows, mean_directions(rows), key))
    placed = running(placed, key, ["angle", "node"], {"rank": F.lit(1).cast("long")}, block=hot)
    placed = written(placed.withColumn("blk", F.floor((F.col("rank") - 1) / block)).withColumn("q", F.floor(F.col("angle") * unit)).drop("rank", "angle"), "crowds")
    blocks = durable(placed.groupBy(*key, "blk").agg(F.min("q").alias("low"), F.max("q").alias("high"), F.sum("n").alias("w")))
    sure = upto(blocks, key, F.col("high"), within - F.col("high"), hot).withColumnRenamed("number", "begin")
    last = upto(blocks, key, F.col("low"), beyond + F.col("high"), hot).select(*key, "blk", F.col("number").alias("end"))
    span = durable(sure.join(last, [*key, "blk"]))
    # blocks 0 to begin - 1 are linked with this one, those from end on are not
    meets = F.when(F.col("begin") < F.col("end"), F.sequence(F.col("begin"), F.col("end") - 1)).otherwise(F.array().cast("array<long>"))
    cells = placed.join(span.select(*key, "blk", F.explode(meets).alias("other")), [*key, "blk"])
    cells = cells.select(F.xxhash64("crowd", "dims", F.least("blk", "other")).alias("g1"), F.xxhash64("crowd", "dims", F.greatest("blk", "other")).alias("g2"), "node", "n", "unit", "blk", "other")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(it):
            node, blk, other = (g[c].to_numpy() for c in ("node", "blk", "other"))
            n, x = g["n"].to_numpy().astype(np.float64), stacked(g["unit"], np.float64)
            i, j = np.flatnonzero(blk <= other), np.flatnonzero(blk >= other)
            if not len(i) or not len(j):
                continue  # the other block lies too far away
            near = (x[i] @ x[j].T >= threshold).astype(np.float64)
            if blk[0] == other[0]:
                np.fill_diagonal(near, 0)
                ids, w = node, near @ n
            else:
                ids, w = np.concatenate([node[i], node[j]]), np.concatenate([near @ n[j], n[i] @ near])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w.astype(np.int64))], ["node", "weight"])

    tried = cells.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(compare, "node long, weight long")
    itself = F.when(F.col("blk") < F.col("begin"), F.col("n")).otherwise(F.lit(0).cast("long"))
    plain = placed.select(*key, "blk", "node", "n").join(span, [*key, "blk"]).select("node", (F.col("weight") - itself).alias("weight"))
    return tried.unionByName(plain).groupBy("node").agg(F.sum("weight").alias("weight"))


def linkable() -> Column:
    """Vectors that may link: not null or zero, all components finite."""
    x = F.col("embedding").cast("array<double>")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))


def neighbour_lists(nodes: DataFrame, threshold: float, least: int, most: int, tables: int, bucket: int, rounds: int, draws: int, probes: int, recall: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int]]:
    """Links, further links that hold crowds together, nodes with full lists, and the last audit (links of the
    probes, those found)."""
    bits = max(0, math.ceil(math.log2(max(1, nodes.count()) / bucket)))
    lists, spans, audit = None, [], (0, 0)
    may = F.col("sim") >= threshold - SLACK

    def entered(pairs: DataFrame) -> int:
        nonlocal lists
        found = written(pairs, "pairs")
        spans.append(durable(found.where("span").select("src", "dst").distinct()))
        before, lists = lists, written(merged(lists, found, threshold, least, most), "lists")
        for df in (found, before):
            if df is not None:
                forget(df)
        return lists.where(may & F.col("fresh")).count()

    for draw in range(draws):
        rows = dealt(bucketed(nodes, range(draw * tables, (draw + 1) * tables), bits, seed)).withColumn("fresh", F.lit(True))
        rows = rows.withColumn("floor", F.lit(-2.0)) if lists is None else rows.join(floors(lists, threshold, least, most).withColumnRenamed("src", "node"), "node", "left").fillna(-2.0, ["floor"])
        entered(compared(rows, threshold, most))
        for _ in range(rounds):
            if entered(joined_locally(nodes, lists, threshold, least, most)) <= 0.002 * lists.where(may).count():
                break
        links = durable(links_of(nodes, lists, threshold))
        full = durable(lists.where(may).groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("src"))
        audit = audited(nodes, links, full, threshold, probes)
        if audit[1] >= recall * audit[0]:
            break
    return links, spans[0] if len(spans) == 1 else durable(unioned(spans)), full, audit


def unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, least: int = 10, most: int = 64, tables: int = 8, bucket: int = 128, rounds: int = 6, draws: int = 4, probes: int = 1024, recall: float = 0.99, seed: int = 13, block: int = 1024
) -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors linked to it), component_id, kept.

    Vectors link at a cosine, in doubles, of ``threshold`` or more; component_id is the smallest vec_id
    reachable, the vector's own included, and kept says that it is its own. Pairs are found by NN-descent, none
    below the threshold is reported, and each draw of planes ends in an audit of ``probes`` vectors against all:
    below ``recall`` further planes are drawn, ``draws`` times at most. Null and zero vectors and those with
    components that are null or not finite link with nothing, vectors of different lengths do not link with
    each other. Equal vectors are one node and link in any number; rows that repeat a vec_id are vectors of
    their own. A null vec_id is no component's smallest and never kept, its row stays. Empty tables stay empty.
    """
    named = written(unit_vectors(vectors.where(linkable())), "units")
    nodes = named.groupBy("h1", "h2", "dims").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(with_sketch(written(nodes, "nodes")), "sketches")
    links, spans, full, _ = neighbour_lists(nodes, threshold, least, most, tables, bucket, rounds, draws, probes, recall, seed)
    parts = durable(connected_components(links.union(spans)))
    sizes = nodes.select("node", "n")

    crowd = full.withColumnRenamed("src", "node")
    listed = links.join(full.withColumn("a", F.lit(1)), "src", "left").join(full.select(F.col("src").alias("dst"), F.lit(1).alias("b")), "dst", "left").where("a is null or b is null")
    listed = listed.select(F.col("src").alias("one"), F.col("dst").alias("node")).union(listed.select(F.col("dst").alias("one"), F.col("src").alias("node")))
    weights = listed.join(sizes, "node").groupBy(F.col("one").alias("node")).agg(F.sum("n").alias("weight"))
    if not crowd.isEmpty():
        rows = nodes.join(crowd, "node").join(parts.withColumnRenamed("id", "node"), "node").select(F.col("component").alias("crowd"), "dims", "node", "n", "unit")
        weights = weights.unionByName(counted(rows, threshold, block)).groupBy("node").agg(F.sum("weight").alias("weight"))
    smallest = parts.join(nodes.select(F.col("node").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("smallest"))
    reached = lookup(parts, smallest, ["component"]).select(F.col("id").alias("node"), "smallest")
    told = nodes.select("node", "h1", "h2", "n", "least").join(weights, "node", "left").join(reached, "node", "left")
    told = durable(told.select("h1", "h2", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")))
    linked = lookup(named.select("vec_id", "h1", "h2"), told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~linkable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

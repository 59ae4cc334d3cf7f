"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint is cut into groups of bits, each group into two-bit segments, and each segment is
replaced by the number of its set bits. In that embedding the Manhattan distance never exceeds the
Hamming distance, so it is a safe filter: when the whole distance is at most ``d``, at least one of
``g`` groups has a Manhattan distance of at most ``d // g``. Each group's vector of counts is one
cell of a grid. Every fingerprint is put into its home cells and into the cells one step up (the
pair that is one step apart meets in the upper cell); fingerprints that meet are verified by their
exact Hamming distance. Only a spanning forest of the verified links of a cell leaves the task, so a
cell of near copies never emits all its pairs.

Groups of copies are folded to one fingerprint row first, so copies cost one row however many there
are. A cell then holds distinct fingerprints only.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import forget
from .common import LOWER_ASCII, connected_components, durable, if_small, maybe_among, ship, unite, written
from .jaccard import block_links, compare_sets, in_blocks, linked_blocks
from .paragraphs import keys_of, least_hashes, marks_of, shingles, word_hashes

ship(__name__)
ship("stockops.llm.common")

#: Odd multipliers and shifts of a 64-bit finaliser; they derive further hash lanes from one hash.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each word shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64)


def lanes_of(hashes: np.ndarray, lanes: int) -> list[int]:
    """Majority bits of the hashes, 64 for each lane, as signed longs. No hash gives zeros."""
    if not len(hashes):
        return [0] * lanes
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = h + np.uint64(GOLDEN * lane % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
            h = h ^ (h >> np.uint64(31))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[at : at + (1 << 16)])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp array<long>) of every whole text. A null text counts as empty: all zeros."""

    def batches(it):
        for batch in it:
            fps = [lanes_of(shingle_hashes(t.as_py(), width), lanes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, fp array<long>")


def forest(ids: np.ndarray, fps: np.ndarray, home: np.ndarray, limit: int, marks: np.ndarray | None = None, fewest: int = 0) -> list[tuple[int, int]]:
    """Spanning links of one cell: rows at most ``limit`` bits apart, one of the two at home. If there are
    ``marks``, the bytes of each row, linked rows also share ``fewest`` of them.

    Compares blocks of home rows with all rows, so memory is bounded whatever the cell holds.
    """
    n = len(ids)
    root = np.arange(n)
    homes = np.flatnonzero(home)
    if len(homes) == n > 2:
        # rows near the first one are linked already; each of the others still meets all rows
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[0]).sum(1, dtype=np.int64) <= limit)
        near = near if marks is None else near[(marks[near] == marks[0]).sum(1) >= fewest]
        root = unite(root, np.zeros(len(near), np.int64), near)
        homes = np.flatnonzero(root)
    step = max(1, (1 << 21) // n)
    for at in range(0, len(homes), step):
        mine = homes[at : at + step]
        near = np.bitwise_count(fps[mine, 0][:, None] ^ fps[None, :, 0]).astype(np.uint16)
        if fps.shape[1] == 1:
            a, b = np.nonzero(near <= limit)
        else:
            a, b = np.nonzero(near <= min(64, limit))
            far = np.zeros(len(a), np.int64)
            for lane in range(fps.shape[1]):
                far += np.bitwise_count(fps[mine[a], lane] ^ fps[b, lane])
            a, b = a[far <= limit], b[far <= limit]
        if marks is not None and len(a):
            alike = np.concatenate([(marks[mine[a[k : k + 65536]]] == marks[b[k : k + 65536]]).sum(1) >= fewest for k in range(0, len(a), 65536)])
            a, b = a[alike], b[alike]
        root = unite(root, mine[a], b)
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if i != r and ids[i] != ids[r]]


def grid_links(nodes: DataFrame, group_bits: int, radius: int, max_distance: int, block: int = 16_000) -> DataFrame:
    """(node, fp) -> (src, dst) verified spanning links, by the grid range-join of the module.

    Cells of more than ``block`` rows are dealt out to blocks. ``group_bits`` divides 64. ``radius`` is 0 or 1: the Manhattan distance a group must keep.
    """
    if 64 % group_bits or radius not in (0, 1):
        raise ValueError("group_bits must divide 64 and radius be 0 or 1")
    mask = (1 << group_bits) - 1
    fives = int("01" * (group_bits // 2), 2)
    lanes = nodes.select(F.size("fp")).head()
    lanes = lanes[0] if lanes else 1
    cells = []
    for lane in range(lanes):
        for part in range(64 // group_bits):
            word = F.shiftrightunsigned(F.col("fp")[lane], part * group_bits).bitwiseAND(F.lit(mask).cast("long"))
            # each two-bit field becomes the number of its set bits
            counts = word - F.shiftright(word, 1).bitwiseAND(F.lit(fives).cast("long"))
            cells.append(F.struct(F.lit(lane * 64 + part).alias("grp"), counts.alias("cell"), F.lit(True).alias("home")))
    rows = nodes.select("node", "fp", F.explode(F.array(*cells)).alias("c")).select("node", "fp", "c.*")
    if radius:
        steps = F.array(*[
            F.when(F.shiftright("cell", 2 * k).bitwiseAND(F.lit(3).cast("long")) < 2, F.col("cell") + F.lit(1 << (2 * k)).cast("long"))
            for k in range(group_bits // 2)
        ])
        up = rows.select("node", "fp", "grp", F.explode(F.array_compact(steps)).alias("cell"), F.lit(False).alias("home"))
        rows = rows.union(up)
    total = nodes.count() * len(cells) * (1 + radius * (group_bits // 2))
    return cell_links(rows, max_distance, block, total)


def crowded_cells(rows: DataFrame, block: int, total: int) -> DataFrame | None:
    """(grp, cell) of more than ``block`` of the ``total`` rows, if there are any.

    Rows are counted by parts of the cells first, four times as many as blocks: only the cells of a part of more
    than ``block`` rows are counted one by one, so hardly any counts are shuffled."""
    part = F.pmod(F.xxhash64("grp", "cell"), F.lit(1 << (4 * total // block).bit_length()).cast("long"))
    full = durable(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("part"))
    if full.isEmpty():
        return None
    few = rows.select("grp", "cell", part.alias("part")).join(F.broadcast(full), "part")
    crowded = durable(few.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("grp", "cell"))
    return None if crowded.isEmpty() else crowded


def cell_links(rows: DataFrame, max_distance: int, block: int, total: int) -> DataFrame:
    """(node, fp, grp, cell, home) -> (src, dst) verified spanning links of the rows of each cell.

    Crowded cells go through ``linked_blocks``: what is near one of their rows is linked by it, and only the
    rest meets all others, block by block. There are fewer of them than rows over ``block``.
    """

    def compare(ids, payload):
        fps = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in payload.chunks]).view(np.uint64).reshape(len(ids), -1)
        home = fps[:, -1].astype(bool)
        return forest(ids, fps[:, :-1], home, max_distance) if home.any() else []

    payload = F.concat("fp", F.array(F.col("home").cast("long")))
    cells = rows.select("grp", "cell", F.col("node").alias("id"), payload.alias("payload"))
    crowded = crowded_cells(rows, block, total)
    if crowded is None:
        return block_links(cells, compare)
    usual = block_links(cells.join(F.broadcast(crowded), ["grp", "cell"], "left_anti"), compare)
    crowd = cells.join(F.broadcast(crowded), ["grp", "cell"]).select(F.xxhash64("grp", "cell").alias("grp"), "id", "payload")
    return usual.union(linked_blocks(in_blocks(crowd, block), compare, block))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    lanes: int = 8,
    group_bits: int = 16,
    radius: int = 0,
    max_distance: int = 70,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id (smallest doc_id reachable).

    With ``lanes=1, group_bits=32, radius=1, max_distance=3`` the search is exact: no link is lost.
    With the defaults it is not: a Jaccard similarity of 0.8 gives about 78 different bits of 512,
    so near-duplicate removal uses ``similar_documents``.

    Null or empty texts have the zero fingerprint and link to each other. Repeated rows each get a
    row. A row without doc_id belongs to the component of its fingerprint (null if no row there has
    an id). An empty table gives an empty table; other columns are ignored.
    """
    fps = durable(fingerprints(docs, width, lanes))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = grid_links(nodes.where("node is not null"), group_bits, radius, max_distance)
    comps = connected_components(links)
    classes = nodes.join(comps.withColumnRenamed("id", "node"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(lane: int = 0):
    """Sixteen lower-case hex digits of a lane."""
    return F.lpad(F.lower(F.hex(F.col("fp")[lane])), 16, "0")


def sketches(docs: DataFrame, width: int, lanes: int, bands: int, rows: int, part_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, row, h, fp, keys, marks) of the set of shingles of every whole text; repeats do not count.

    ``row``: hash of the text. ``h``: hash of the set; a set of no shingles has no keys and no ``marks``, the bytes of
    its MinHash values. Texts are worked
    on in parts of some ``part_bytes``, or one text if it is longer."""

    def batches(it):
        for batch in it:
            texts, first, n = batch.column(2).to_pylist(), 0, 0
            for i, text in enumerate(texts):
                n += len(text or b"")
                if n < part_bytes and i < len(texts) - 1:
                    continue
                with np.errstate(over="ignore"):
                    sets = [shingle_set(t, width) for t in texts[first : i + 1]]
                    some = [s for s in sets if len(s)]
                    least = least_hashes(np.concatenate(some), np.cumsum([0, *map(len, some[:-1])]), bands * rows) if some else np.empty((0, bands * rows), np.uint64)
                    keys, marks = (iter(x.tolist()) for x in (keys_of(least, bands, rows), marks_of(least)))
                    fps = [lanes_of(s, lanes) for s in sets]
                part = batch.slice(first, len(sets))
                columns = [part.column(0), part.column(1), pa.array(map(set_name, sets), pa.int64()), pa.array(fps, pa.list_(pa.int64())), *[pa.array([next(x) if len(s) else [] for s in sets], pa.list_(pa.int64())) for x in (keys, marks)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "h", "fp", "keys", "marks"])
                first, n = i + 1, 0

    return named(docs).mapInArrow(batches, "doc_id long, row long, h long, fp array<long>, keys array<long>, marks array<long>")


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct shingles of a text, sorted; a text of fewer words is one shingle."""
    words = (text or b"").translate(LOWER_ASCII).split()
    return np.unique(shingles(word_hashes(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def set_name(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - 2**63


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows apart that repeat a doc_id with different texts."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, max_broadcast: int) -> DataFrame:
    """(grp, pivot, k, id, payload) of the texts of ``wanted`` (doc_id, row, grp, pivot, k, id), read again."""

    def batches(it):
        for batch in it:
            with np.errstate(over="ignore"):
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.list_(pa.int64()))], ["grp", "pivot", "k", "id", "payload"])

    texts = named(docs)
    if wanted.count() * 64 <= max_broadcast:
        asked = F.broadcast(wanted)
    else:
        # few texts are shuffled, and none is sorted
        texts, asked = maybe_among(texts, ["doc_id", "row"], wanted, max_broadcast).where("maybe"), wanted.hint("shuffle_hash")
    found = texts.alias("t").join(asked.alias("w"), same_row("t", "w")).select("text", "grp", "pivot", "k", "id")
    # rows that repeat doc_id and text give their set more than once
    return found.mapInArrow(batches, "grp long, pivot long, k int, id long, payload array<long>")


def similar_rows(docs: DataFrame, threshold: float, width: int, lanes: int, group_bits: int, radius: int, bands: int, rows: int, max_distance: int, block: int, max_broadcast: int) -> DataFrame:
    """(doc_id, row, component) of each row of ``docs``; a component is named by one of its sets.

    Candidates come from the grid range-join of the fingerprints, as far as it loses no pair, and, beyond its radius,
    from bands; rows that meet in a band must also share enough MinHash values, so that rows which chance brings
    together are not chained to components that grow faster than the table."""
    prints = written(sketches(docs, width, lanes, bands, rows), "sketches")
    nodes = written(prints.groupBy(F.col("h").alias("id")).agg(F.min(F.struct("doc_id", "row")).alias("at"), *[F.first(c).alias(c) for c in ("fp", "keys", "marks")]), "nodes")
    cells = nodes.select("id", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("grp"), "id")
    met = written(in_blocks(cells, 16 * block).join(nodes.select("id", F.concat("fp", "marks").alias("payload")), "id"), "cells")
    within = min(max_distance, lanes * 64 // group_bits * (radius + 1) - 1)
    near = written(grid_links(nodes.select(F.col("id").alias("node"), "fp"), group_bits, radius, within, 16 * block), "near")
    compare = compare_prints(lanes, max_distance, bands * rows, fewest_equal(bands * rows, threshold))
    maybe = connected_components(near.union(linked_blocks(met, compare, 16 * block)))
    wanted = in_blocks(maybe.withColumnRenamed("component", "grp"), block).join(nodes, "id").select("at.doc_id", "at.row", "grp", "pivot", "k", "id")
    sets = written(shingle_sets(docs, durable(wanted), width, max_broadcast), "shingles")
    comps = connected_components(linked_blocks(sets, compare_sets(threshold), block)).withColumnRenamed("id", "h")
    for table in (met, near, sets):
        forget(table)
    return prints.select("doc_id", "row", "h").join(comps, "h", "left").select("doc_id", "row", F.coalesce("component", "h").alias("component"))


def fewest_equal(n: int, threshold: float, loss: float = 1e-6) -> int:
    """Equal values of two signatures of ``n`` that pairs of similarity ``threshold`` fall short of with a chance of
    ``loss`` at most."""
    if not 0 < threshold < 1:
        return n if threshold >= 1 else 0
    below = 0.0
    for k in range(n):
        below += exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(threshold) + (n - k) * log(1 - threshold))
        if below > loss:
            return k
    return n


def compare_prints(lanes: int, limit: int, n: int, fewest: int):
    """Compares rows by the Hamming distance of their fingerprints and by the bytes of their MinHash values."""

    def compare(ids, payload):
        rows = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in payload.chunks]).view(np.uint64).reshape(len(ids), -1)
        marks = np.ascontiguousarray(rows[:, lanes:]).view(np.uint8)[:, :n]
        return forest(ids, np.ascontiguousarray(rows[:, :lanes]), np.ones(len(ids), bool), limit, marks, fewest)

    return compare


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    lanes: int = 2,
    group_bits: int = 32,
    radius: int = 1,
    bands: int = 16,
    rows: int = 3,
    max_distance: int = 44,
    block: int = 1000,
    max_broadcast: int = 8 << 20,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, component_id (smallest doc_id reachable by links).

    Two texts are linked if the Jaccard similarity of their sets of shingles reaches ``threshold``;
    this is decided on the sets themselves. Candidates meet in the grid of the fingerprints, which loses
    no pair within 7 of 128 bits (``group_bits`` and ``radius`` as in ``grid_links``) and links these only, or
    share a band of a MinHash signature, for pairs beyond that radius; then they differ in at most ``max_distance``
    of the fingerprint's bits and share 24 of 48 MinHash values, as pairs at 0.8 do but for one in a million. A pair at 0.8 shares no band with a chance of 0.00001, and differs in 19 bits on
    average (deviation 4; 24 and 4.5 for sets of four and five).
    All rows of a component of candidates are compared, whichever candidates joined it. Buckets and
    components of more than some rows are dealt out to blocks. Sets are named by 64-bit hashes.

    Null or empty texts link to each other. Rows that repeat a doc_id with other texts are rows of their
    own. A component without any doc_id has none. Repeated rows each get a row; an empty table gives an
    empty table; other columns are ignored.
    """
    found = durable(similar_rows(docs, threshold, width, lanes, group_bits, radius, bands, rows, max_distance, block, max_broadcast))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, max_broadcast: int = 8 << 20, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id (then the smallest
    hash of its text); rows without doc_id come last.

    Rows are judged, not doc_ids: rows that repeat a doc_id with unrelated texts all stay; of rows equal
    in doc_id and text one stays, whatever their other columns. Null or empty texts are one group. Texts
    are not shuffled while the rows that go fit ``max_broadcast`` bytes; beyond that the rows that may go are, a
    sixteenth of the others with them. An empty table stays empty.
    """
    settings = {"threshold": 0.8, "width": 5, "lanes": 2, "group_bits": 32, "radius": 1, "bands": 16, "rows": 3, "max_distance": 44, "block": 1000}
    rows = similar_rows(docs.select("doc_id", "text"), **(settings | options), max_broadcast=max_broadcast)
    rows = durable(rows.groupBy("doc_id", "row", "component").agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    judged = rows.join(best, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row")))
    judged = durable(judged.where("not stays or n > 1").select("doc_id", "row", "stays"))
    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("whole")).alias("d")
    if judged.count() * 24 <= max_broadcast:
        found = held.join(F.broadcast(judged).alias("j"), same_row("d", "j"), "left").select("d.*", "stays")
        out = found.where("stays is null").select("whole.*")
    else:
        # rows that surely stay are not shuffled, and none is sorted
        held = maybe_among(held, ["doc_id", "row"], judged, max_broadcast)
        found = held.where("maybe").alias("d").join(judged.hint("shuffle_hash").alias("j"), same_row("d", "j"), "left").select("d.*", "stays")
        out = held.where("not maybe").union(found.where("stays is null").select(*held.columns)).select("whole.*")
    if judged.where("stays").isEmpty():
        return out
    # of rows equal in doc_id and text one stays
    copies = found.where("stays").withColumn("nr", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy(F.xxhash64("whole"))))
    return out.union(copies.where("nr = 1").select("whole.*"))

"""Substring duplicates: paragraph MinHash banding, exact Jaccard, removal by components.

Two kinds of paragraph are compared. *Lines* of a text get MinHash signatures over five-word shingles;
``bands`` of ``rows_per_band`` values are tuned so that a pair at the threshold collides with a chance
above 99 %. Colliding lines are verified by exact Jaccard on their shingles and clustered by
components. *Pieces* are cut where the text itself says so: a piece begins at a word whose hash (with
the next word) is the least within ``radius`` words on either side. Cuts depend on those words alone, so
a passage falls into the same pieces wherever it was pasted, in the middle of a line, over several short
lines or without any full stop; equal pieces are repeats.

Equal lines fold to one node before they are banded into buckets, and texts are read twice: once whole,
and once for the lines that met another one in a bucket. Members of a bucket are linked to its least
one, large components of candidates are verified block by block (see ``jaccard``), and every grouping
adds up within partitions before it is shuffled. Repeats of a document that touch are merged to
passages; passages of at least ``min_passage`` words are reported.

Paragraphs are named by 64-bit hashes of their words. Among 10**12 pieces some 10**4 pairs meet by
chance, each as a repeat of a few words, far below a passage; among 10**11 lines some 300 do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, connected_components, durable, if_small, ship, written
from .jaccard import compare_sets, in_blocks, linked_blocks

ship(__name__)
ship("stockops.llm.common")

#: Odd multipliers of hash combinations, and the inverse of the first modulo 2**64.
PRIME, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BACK = np.uint64(pow(int(PRIME), -1, 2**64))
MOST = np.uint64(2**64 - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX_B
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` words from each place on, for the places that have as many."""
    out = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        out = out * PRIME + w[k : k + len(out)]
    return mixed(out)


def line_shingles(w: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of one line; a line of fewer words is one shingle."""
    return np.unique(shingles(w, min(width, len(w)))) if len(w) else np.empty(0, np.uint64)


class Runs:
    """64-bit hashes of runs of words, from one cumulative sum."""

    def __init__(self, w: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * np.cumprod(np.full(len(w), PRIME)))])
        self.back = np.cumprod(np.full(len(w) + 1, BACK))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def least_hashes(grams: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """MinHash signatures of ``n`` values, a row for each run of ``grams`` that starts at ``begin``."""
    out = np.empty((len(begin), n), np.uint64)
    for k in range(n):
        seed = 0xD1B54A32D192ED03 * (k + 1) % 2**64
        out[:, k] = np.minimum.reduceat((grams ^ np.uint64(seed)) * np.uint64(seed | 1), begin)
    return out


def keys_of(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signed 64-bit band keys of signatures of ``bands * rows`` values."""
    out = np.empty((len(least), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(least), b + 1, np.uint64)
        for r in range(rows):
            key = mixed(key * MIX_A + least[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def band_keys(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signed 64-bit band keys, a row for each run of ``grams`` that starts at ``begin``."""
    return keys_of(least_hashes(grams, begin, bands * rows), bands, rows)


def marks_of(least: np.ndarray) -> np.ndarray:
    """One byte of each value of a signature, packed in longs: rows share a byte as often as they share a value,
    or by chance in one of 256."""
    low = (mixed(least) & np.uint64(255)).astype(np.uint8)
    return np.pad(low, ((0, 0), (0, -low.shape[1] % 8))).view(np.int64)


def piece_starts(w: np.ndarray, begin: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Places of ``w`` at which a piece begins. Texts lie apart by at least ``radius`` blank places."""
    inside = np.zeros(len(w) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes, -1)
    inside = np.cumsum(inside[:-1]) > 0
    g = mixed(w * PRIME + np.append(w[1:], np.uint64(0)) * MIX_A)
    g[~inside] = MOST
    first = inside.copy()
    for j in range(1, radius + 1):
        first[j:] &= g[j:] < g[:-j]
        first[:-j] &= g[:-j] <= g[j:]
    first[begin[sizes > 0]] = True
    return np.flatnonzero(first)


def paragraphs_of(texts: list[bytes | None], min_line: int, min_piece: int, radius: int, width: int, bands: int, rows: int) -> tuple:
    """Paragraphs of some texts: text number, is line, start, end (words), hash, band keys of the lines."""
    words, begin, sizes, line_ends, at = [], [], [], [], radius
    for text in texts:
        begin.append(at + len(words))
        for line in (text or b"").translate(LOWER_ASCII).split(b"\n"):
            if found := line.split():
                words += found
                line_ends.append((len(begin) - 1, at + len(words) - len(found), at + len(words)))
        sizes.append(at + len(words) - begin[-1])
        at += radius
    w = np.zeros(len(words) + at + 1, np.uint64)
    begin, sizes = np.array(begin, np.int64), np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w[np.arange(len(words)) + radius * (owner + 1)] = word_hashes(words)
    runs = Runs(w)

    start = piece_starts(w, begin, sizes, radius)
    text = np.searchsorted(begin, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(w)), (begin + sizes)[text])
    text, start, end = (x[end - start >= min_piece] for x in (text, start, end))

    lines = np.array(line_ends, np.int64).reshape(-1, 3)
    lines = lines[lines[:, 2] - lines[:, 1] >= min_line]
    size = lines[:, 2] - lines[:, 1] - width + 1
    keys = np.empty((0, bands), np.int64)
    if len(lines):
        first = np.cumsum(size) - size
        place = np.repeat(lines[:, 1] - first, size) + np.arange(int(size.sum()))
        keys = band_keys(shingles(w, width)[place], first, bands, rows)
    return (
        np.concatenate([text, lines[:, 0]]),
        np.repeat([False, True], [len(text), len(lines)]),
        np.concatenate([start - begin[text], lines[:, 1] - begin[lines[:, 0]]]),
        np.concatenate([end - begin[text], lines[:, 2] - begin[lines[:, 0]]]),
        np.concatenate([runs(start, end), runs(lines[:, 1], lines[:, 2])]).view(np.int64),
        keys,
    )


def units(docs: DataFrame, min_line: int, min_piece: int, radius: int, width: int, bands: int, rows: int, part_bytes: int = 1 << 20) -> DataFrame:
    """Paragraphs of every whole text: doc_id, row, is_line, start, end, h, keys.

    Texts are worked on in parts of some ``part_bytes``, or one text if it is longer.
    """
    if min_line < width:
        raise ValueError("min_line must be at least width")

    def batches(it):
        for batch in it:
            texts, first, n = batch.column(2).to_pylist(), 0, 0
            for i, text in enumerate(texts):
                n += len(text or b"")
                if n < part_bytes and i < len(texts) - 1:
                    continue
                with np.errstate(over="ignore"):
                    number, is_line, start, end, h, keys = paragraphs_of(texts[first : i + 1], min_line, min_piece, radius, width, bands, rows)
                here = pa.array(first + number)
                offsets = np.concatenate([np.zeros(len(number) - len(keys), np.int32), np.arange(len(keys) + 1, dtype=np.int32) * bands])
                columns = [
                    batch.column(0).take(here), batch.column(1).take(here), pa.array(is_line), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "is_line", "start", "end", "h", "keys"])
                first, n = i + 1, 0

    return named(docs).mapInArrow(batches, "doc_id long, row long, is_line boolean, start int, end int, h long, keys array<long>")


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows apart that repeat a doc_id with different texts."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))


def candidates(nodes: DataFrame, max_broadcast: int) -> DataFrame:
    """(id, component) of the lines that share a bucket with another one, directly or by others.

    Every bucket is reduced to its least and greatest line within partitions first; only buckets of
    more lines are met again by their members.
    """
    members = nodes.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    buckets = durable(buckets)
    ends = buckets.select(F.col("low").alias("src"), F.col("high").alias("dst"))
    large = if_small(buckets.where("n > 2").select("band", "key", "low"), 24, max_broadcast)
    inner = members.join(large, ["band", "key"]).where("id <> low").select(F.col("low").alias("src"), F.col("id").alias("dst"))
    return connected_components(ends.union(inner))


def line_classes(nodes: DataFrame, lines: DataFrame, docs: DataFrame, width: int, threshold: float, block: int, max_broadcast: int) -> DataFrame:
    """(id, component) of the lines that have a verified near copy. nodes: id, keys; lines: id, doc_id, row, start."""
    wanted = durable(in_blocks(candidates(nodes, max_broadcast).withColumnRenamed("component", "grp"), block))
    # a line that many rows hold is one place before it is joined
    where = lines.groupBy("id").agg(F.min(F.struct("doc_id", "row", "start")).alias("at")).join(wanted, "id")
    spots = where.groupBy("at.doc_id", "at.row").agg(F.collect_list(F.struct("at.start", "id", "grp", "pivot", "k")).alias("spots"))
    spots = durable(spots)
    n_bytes = spots.agg(F.sum(F.lit(32) + 48 * F.size("spots"))).head()[0] or 0

    def fetch(it):
        """Shingles of the wanted lines, read from their text again."""
        for batch in it:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, wanted = 0, {s["start"]: s for s in found}
                for line in text.as_py().translate(LOWER_ASCII).split(b"\n"):
                    words = line.split()
                    spot = wanted.get(at) if words else None
                    at += len(words)
                    if spot:
                        with np.errstate(over="ignore"):
                            grams = line_shingles(word_hashes(words), width)
                        for column, value in zip(out, (spot["grp"], spot["pivot"], spot["k"], spot["id"], grams.view(np.int64)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["grp", "pivot", "k", "id", "payload"])

    texts, s = named(docs).alias("t"), (F.broadcast(spots) if n_bytes <= max_broadcast else spots).alias("s")
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.row") == F.col("s.row"))
    found = texts.join(s, same).select("text", "spots").mapInArrow(fetch, "grp long, pivot long, k int, id long, payload array<long>")
    # rows that repeat doc_id and text give their lines more than once
    sets = written(found, "lines")
    return connected_components(linked_blocks(sets, compare_sets(threshold), block))


def repeated_passages(
    docs: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 10,
    rows_per_band: int = 4,
    min_line: int = 8,
    min_piece: int = 4,
    radius: int = 4,
    min_passage: int = 12,
    block: int = 1000,
    max_broadcast: int = 8 << 20,
) -> DataFrame:
    """One row for each passage of a document that repeats in another one: doc_id, start, end (words),
    n_words (of them repeated), class_id, first_doc_id, removed.

    ``class_id`` is shared by passages that hold the same repeated paragraph; ``first_doc_id`` is the
    smallest doc_id that holds it; ``removed`` is false where a class is kept: in its smallest doc_id.
    A passage that was pasted is seen but for incomplete pieces at its ends, at most some ``4 * radius``
    words; gaps of that size do not part a passage.

    What repeats within one document only is left alone. Documents without repeats have no row. Null and
    empty texts have no paragraphs. Rows that repeat a doc_id with another text are rows of their own;
    rows that repeat doc_id and text are one. Rows without doc_id repeat each other's passages, and a
    class of such rows only is kept in all of them. Empty tables give empty tables; other columns are
    ignored.
    """
    found = written(units(docs, min_line, min_piece, radius, width, bands, rows_per_band), "paragraphs")
    n = F.count("doc_id")
    apart = (F.min("doc_id") < F.max("doc_id")) | (F.min("row") < F.max("row")) | ((n > 0) & (n < F.count(F.lit(1))))
    seen = [F.min("doc_id").alias("first"), F.coalesce(apart, F.lit(False)).alias("repeats")]
    ends = {"last": F.max("doc_id"), "low_row": F.min("row"), "high_row": F.max("row")}

    pieces = found.where("not is_line").select(F.col("h").alias("id"), "doc_id", "row", "start", "end")
    twice = pieces.groupBy("id").agg(*seen).where("repeats").select("id", "first")
    of_pieces = pieces.join(twice, "id").select("doc_id", "row", "start", "end", F.col("id").alias("class_id"), "first")

    lines = found.where("is_line").withColumnRenamed("h", "id")
    keys = [F.min(F.col("keys")[b]).alias(f"k{b}") for b in range(bands)]
    nodes = lines.groupBy("id").agg(*seen, *[e.alias(name) for name, e in ends.items()], *keys)
    nodes = durable(nodes.select("id", "first", "repeats", *ends, F.array(*[f"k{b}" for b in range(bands)]).alias("keys")))
    lines = lines.select("id", "doc_id", "row", "start", "end")
    classes = line_classes(nodes.select("id", "keys"), lines, docs, width, threshold, block, max_broadcast)
    # lines with near copies, and lines that merely repeat; in both cases in another row
    labelled = nodes.drop("keys").join(classes, "id", "left").where("component is not null or repeats").withColumn("component", F.coalesce("component", "id"))
    apart = F.max("repeats") | F.coalesce(F.min("first") < F.max("last"), F.lit(False)) | (F.min("low_row") < F.max("high_row"))
    kept = labelled.groupBy("component").agg(F.min("first").alias("first"), apart.alias("repeats")).where("repeats").drop("repeats")
    kept = labelled.select("id", "component").join(kept, "component").select("id", F.col("component").alias("class_id"), "first")
    of_lines = lines.join(kept, "id").select("doc_id", "row", "start", "end", "class_id", "first")

    hits = of_pieces.union(of_lines).withColumn("removed", ~F.col("doc_id").eqNullSafe(F.col("first")))
    order = Window.partitionBy("doc_id", "row").orderBy("start", "end", "class_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("reach", F.coalesce(reach, F.lit(-1)))
    fresh = F.when((F.col("reach") < 0) | (F.col("start") > F.col("reach") + 4 * radius), 1).otherwise(0)
    hits = hits.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).withColumn("passage", F.sum(fresh).over(order))
    merged = hits.groupBy("doc_id", "row", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("new").alias("n_words"), F.min(F.struct("first", "class_id")).alias("class"), F.max("removed").alias("removed")
    )
    return merged.where(F.col("n_words") >= min_passage).select("doc_id", "start", "end", "n_words", F.col("class.class_id").alias("class_id"), F.col("class.first").alias("first_doc_id"), "removed")

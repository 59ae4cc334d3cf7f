"""Exact vector retrieval with filters, tag boosts and graph expansion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_keys
from ..functions.python import ship

ship(__name__)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest of each row with their ids (ties: the smaller id): row, id, similarity, row by row."""
    n = sims.shape[1]
    least = -np.partition(-sims, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
    row, at = np.nonzero(sims >= least[:, None])
    own, value = ids[row, at] if ids.ndim == 2 else ids[at], sims[row, at]
    order = np.lexsort((own, -value, row))
    row, own, value = row[order], own[order], value[order]
    first = np.searchsorted(row, np.arange(len(sims)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], own[keep], value[keep]


def cell_topk(k: int, chunk: int):
    """Best vectors of the queries of each cell. Rows come sorted by cell, queries first; only the queries and
    their best so far are held, vectors pass by."""

    def batches(it):
        key, held, q, best = None, [], None, None

        def done():
            if best is None:
                return
            names, row, own, value = best
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(own), pa.array(value)], ["query_id", "vec_id", "similarity"])

        for batch in it:
            if not batch.num_rows:
                continue
            cells = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1, [len(cells)]])
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                *cell, side = cells[start].tolist()
                part = batch.slice(int(start), int(end - start))
                if cell != key:
                    yield from done()
                    key, held, q, best = cell, [], None, None
                ids = part.column(4).to_numpy()
                rows = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if side == 0:
                    held.append((ids, unit(rows)))
                    continue
                if not held:
                    continue
                if q is None:
                    q = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                for at in range(0, len(ids), chunk):
                    sims = np.round(q[1] @ unit(rows[at : at + chunk]).T, 9)
                    row, own, value = best_of(sims, ids[at : at + chunk], k)
                    if best is not None:  # merge with the best so far
                        row, own, value = (np.concatenate(x) for x in zip(best[1:], (row, own, value), strict=True))
                        order = np.lexsort((own, -value, row))
                        row, own, value = row[order], own[order], value[order]
                        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                        row, own, value = row[keep], own[keep], value[keep]
                    best = q[0], row, own, value
        yield from done()

    return batches


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, query_rows: int = 4096, vector_rows: int = 1 << 18, chunk: int = 4096) -> DataFrame:
    """The k most similar vectors of each query by cosine: query_id, vec_id, similarity, rank.

    queries: (query_id, embedding); vectors: (vec_id, embedding). Both sides are dealt to blocks, and every block
    of queries meets every block of vectors in a cell of its own: a matrix product that keeps the k best of each
    query, which are merged at the end. Nothing passes through the driver; queries are copied once for
    each ``vector_rows`` vectors and vectors once for each ``query_rows`` queries. Null embeddings are left out,
    zero vectors are similar to nothing (0), vectors of another length are not compared. Ties go to the
    smaller vec_id.
    """
    side = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).where("e is not null and id is not null")
    q, v = side(queries, "query_id"), side(vectors, "vec_id")
    nq, nv = max(1, -(-q.count() // query_rows)), max(1, -(-v.count() // vector_rows))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = q.select(block(nq).alias("qb"), every(nv).alias("vb"), F.size("e").cast("long").alias("dims"), F.lit(0).cast("long").alias("side"), "id", "e")
    rows = v.select(every(nq).alias("qb"), block(nv).alias("vb"), F.size("e").cast("long").alias("dims"), F.lit(1).cast("long").alias("side"), "id", "e")
    cells = asks.unionByName(rows).repartition("qb", "vb", "dims").sortWithinPartitions("qb", "vb", "dims", "side")
    found = cells.mapInArrow(cell_topk(k, chunk), "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def metadata_filter(schema: DataFrame, conditions: Sequence[tuple[str, str, object]], any_of: bool = False) -> Column:
    """Conditions (field, EQ or IN, value) joined by AND or OR; IN on a list field means any of them."""
    lists = {f.name for f in schema.schema.fields if f.dataType.typeName() == "array"}

    def one(field, op, value):
        c = F.col(field)
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        if field in lists:
            return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])), F.lit(False))
        return c.isin(values) if op == "IN" else c == values[0]

    if not conditions:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), [one(*c) for c in conditions])


def scope_filters(part: str | None = None, section: str | None = None, subsection: str | None = None, subsubsection: str | None = None, page: int | None = None) -> list[tuple[str, str, object]]:
    fields = {"part": part, "section_number": section, "subsection_number": subsection, "subsubsection_number": subsubsection, "page": page}
    return [(f, "EQ", v) for f, v in fields.items() if v is not None]


def tag_boost(hits: DataFrame, concepts: Sequence[str], tables: Sequence[str], k: int, bonus: float = 0.1) -> DataFrame:
    """Hits (query_id, rank, similarity, bc_concepts, bc_db_tables) reranked: a bonus for each tag
    shared, 1.0 at most, earlier rank first among equals, cut to k."""
    if concepts or tables:
        shared = lambda c, tags: F.size(F.array_intersect(F.coalesce(c, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags]).cast("array<string>")))
        score = F.least(F.lit(1.0), F.coalesce("similarity", F.lit(0.0)) + bonus * (shared("bc_concepts", concepts) + shared("bc_db_tables", tables)))
        hits = hits.withColumn("similarity", F.round(score, 9))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("rank"))
    else:
        w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_graph(roots: DataFrame, edges: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Chunks one reference away from roots (query_id, chunk_id): query_id, root_id, field, chunk_id."""
    e = edges if fields is None else edges.where(F.col("field").isin(list(fields)))
    return roots.select("query_id", F.col("chunk_id").alias("root_id")).join(e.select(F.col("src").alias("root_id"), "field", F.col("dst").alias("chunk_id")), "root_id").select("query_id", "root_id", "field", "chunk_id")


def dedupe_first_seen(rows: DataFrame, position: str = "position") -> DataFrame:
    """First row of each (query_id, chunk_id); rows without chunk_id all stay."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy(position)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1 or chunk_id is null").drop("rn")


def search_knowledge(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, edges: DataFrame, k: int, concepts: Sequence[str] = (), tables: Sequence[str] = (), scope: Sequence[tuple[str, str, object]] = (), fields: Sequence[str] | None = None) -> DataFrame:
    """Scope, top-k (k + 10 where tags boost), boost, one-hop expansion, first-seen dedupe."""
    inside = chunks.where(metadata_filter(chunks, scope)).select("chunk_id", "vec_id", "bc_concepts", "bc_db_tables")
    fetch = k + 10 if concepts or tables else k
    hits = vector_topk(vectors.join(inside.select("vec_id"), "vec_id", "left_semi"), queries, fetch).join(inside, "vec_id")
    best = tag_boost(hits, concepts, tables, k)
    roots = best.select("query_id", "chunk_id", (F.col("rank") * 1_000_000).cast("long").alias("position"), "similarity")
    more = expand_graph(best, edges, fields).join(best.select("query_id", F.col("chunk_id").alias("root_id"), "rank"), ["query_id", "root_id"])
    w = Window.partitionBy("query_id").orderBy("rank", "field", "chunk_id")
    more = more.select("query_id", "chunk_id", (F.lit(10**12) + F.row_number().over(w)).cast("long").alias("position"), F.lit(None).cast("double").alias("similarity"))
    return dedupe_first_seen(roots.union(more))


def entity_by_number(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """First loaded chunk of each wanted (chunk_type, entity_id)."""
    df = chunks.join(wanted.select("chunk_type", "entity_id").distinct(), ["chunk_type", "entity_id"], "left_semi")
    return df.groupBy("chunk_type", "entity_id").agg(F.min_by("chunk_id", "load_order").alias("chunk_id"))


def get_by_ids(chunks: DataFrame, ids) -> DataFrame:
    return by_keys(chunks, ids, "chunk_id")


def tag_catalog(catalog: DataFrame, category: str | None = None) -> DataFrame:
    """Tags by category from rows with a map column ``tags``."""
    df = catalog.select(F.explode("tags").alias("category", "tag_list")).select("category", F.explode("tag_list").alias("tag")).distinct()
    return df if category is None else df.where(F.col("category") == category)

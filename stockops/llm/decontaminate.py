"""Benchmark decontamination by suffix arrays over shards of the training text.

Every batch of documents is a shard. Its words become numbers of the test vocabulary (other words
cannot take part in a match and cut the text), the suffixes that could hold a window are sorted by
prefix doubling, and every test suffix is binary-searched in that array. Matches are extended to
their longest verbatim length and reported with their place in document and item. The test set
travels in blocks of bounded size, one at a time, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

ship(__name__)

#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPAN = "array<struct<item_id:string,item_start:int,start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class TestBlock:
    """Suffixes of a bounded number of test items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        flat, owner, place, need, at = [], [], [], [], 0
        self.starts = []
        for k, (_, words) in enumerate(items):
            least = min(window, len(words))
            for i in range(len(words) - least + 1 if words else 0):
                self.starts.append(at + i)
                owner.append(k)
                place.append(i)
                need.append(least)
            flat += [number(w) for w in words] + [0]
            at += len(words) + 1
        self.text = np.array(flat + [0] * window, np.int64)
        self.starts, self.owner, self.place, self.need = (np.array(x, np.int64) for x in (self.starts, owner, place, need))
        self.least = int(self.need.min()) if len(self.need) else 0


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` words of their suffixes, then of the word before."""
    rank, step = text, 1
    while step < depth:
        ahead = np.zeros_like(rank)
        by = min(step, depth - step)  # exactly depth words in the end
        ahead[:-by] = rank[by:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return starts[np.lexsort((text[starts - 1], rank[starts]))]


def bisect(text: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """For each range [low, high) of ``order``: where words at ``depth`` reach (or pass) the target."""
    low, high = low.copy(), high.copy()
    while (wide := low < high).any():
        mid = (low + high) >> 1
        word = text[order[np.minimum(mid, len(order) - 1)] + depth]
        below = (word <= target) if right else (word < target)
        low = np.where(wide & below, mid + 1, low)
        high = np.where(wide & ~below, mid, high)
    return low


#: Words by which matches grow one at a time before ranks of longer runs are made.
STEPS = 64


def common_words(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words of a from each i and of b from each j, up to a cut (0), by ranks of runs of 1, 2, 4, ... words."""
    both = np.concatenate([a, [0], b, [0]])
    both[both == 0] = -1 - np.arange(int((both == 0).sum()))  # no cut equals another
    j = j + len(a) + 1
    ranks, step = [np.unique(both, return_inverse=True)[1].astype(np.int64)], 1
    while True:
        ahead = np.full(len(both), -1)
        ahead[:-step] = ranks[-1][step:]
        longer = np.unique(ranks[-1] * (len(both) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        if (longer[np.minimum(i, len(both) - 1)] != longer[np.minimum(j, len(both) - 1)]).all():
            break
        ranks.append(longer)
        step *= 2
    n = np.zeros(len(i), np.int64)
    last = len(both) - 1
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2):
            n += np.where(ranks[k][np.minimum(i + n, last)] == ranks[k][np.minimum(j + n, last)], 1 << k, 0)
    return n


def search(shard: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches of a shard's numbered words: (test suffix, place in shard, length)."""
    none = np.empty(0, np.int64)
    if not block.least or not len(shard):
        return none, none, none
    known = shard > 0
    # runs of known words; only runs that can hold a window are kept
    ends = np.append(np.flatnonzero(~known), len(shard))
    run = np.cumsum(~known)
    left_of, right_of = np.append(-1, ends)[run], ends[np.minimum(run, len(ends) - 1)]
    keep = known & (right_of - left_of - 1 >= block.least)
    inner = np.flatnonzero(keep)
    if not len(inner):
        return none, none, none
    gap = np.append(np.diff(inner) > 1, True)
    size = np.ones(len(inner), np.int64) + gap
    place = np.cumsum(size) - size
    text = np.zeros(int(size.sum()) + block.window + 1, np.int64)
    text[place] = shard[inner]
    origin = np.zeros(len(text), np.int64)
    origin[place] = inner
    starts = place[right_of[inner] - inner >= block.least]
    order = suffix_array(text, starts, block.window)

    low, high = np.zeros(len(block.starts), np.int64), np.full(len(block.starts), len(order))
    for d in range(block.window):
        on = np.flatnonzero((block.need > d) & (low < high))
        if not len(on):
            break
        target = block.text[block.starts[on] + d]
        lo, hi = low[on], high[on]
        low[on], high[on] = bisect(text, order, d, lo, hi, target, False), bisect(text, order, d, lo, hi, target, True)
    # where the word before a match is the test's as well, the match is the inside of a longer one: those
    # places stand together in each range and are left out before any place is listed
    inside, outside = high.copy(), high.copy()
    on = np.flatnonzero((block.need == block.window) & (block.place > 0) & (low < high))
    before = block.text[block.starts[on] - 1]
    inside[on], outside[on] = bisect(text, order, -1, low[on], high[on], before, False), bisect(text, order, -1, low[on], high[on], before, True)
    tests = np.arange(len(low))
    which, low, high = np.concatenate([tests, tests]), np.concatenate([low, outside]), np.concatenate([inside, high])
    count = np.maximum(high - low, 0)
    which = np.repeat(which, count)
    if not len(which):
        return none, none, none
    at = order[np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    length = block.need[which].copy()
    grow = np.arange(len(which))
    for _ in range(STEPS):
        t, s = block.text[np.minimum(block.starts[which[grow]] + length[grow], len(block.text) - 1)], text[np.minimum(at[grow] + length[grow], len(text) - 1)]
        grow = grow[(t == s) & (t > 0)]
        length[grow] += 1
        if not len(grow):
            break
    if len(grow):
        length[grow] += common_words(block.text, block.starts[which[grow]] + length[grow], text, at[grow] + length[grow])
    return which, origin[at], length


def blocks_of(benchmark: DataFrame, window: int, max_words: int) -> Iterator[tuple[Broadcast, bool]]:
    """Test items in blocks of some ``max_words`` words at most, dealt by hash, each with whether it is
    the last. One block exists at a time: it is gathered when it is asked for, and taken from driver and
    executors when the next one is, so its results must be written by then."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    # a word and what parts it from the next are two characters at least
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).head()[0] or 0) // (2 * max_words)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    held = None
    for k in range(n):
        if held is not None:
            held.destroy()
        held = sc.broadcast(TestBlock([(r[0], words_of(r[1])) for r in items.where(block == k).collect()], window))
        yield held, k == n - 1


def numbered(texts: pa.ChunkedArray | pa.Array, block: TestBlock, shard_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts of a batch in shards of some ``shard_words`` words: first text, word numbers of each text."""
    get = block.vocabulary.get
    first, numbers, n = 0, [], 0
    for i, text in enumerate(texts):
        words = words_of(text.as_py())
        numbers.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        n += len(words)
        if n >= shard_words or i == len(texts) - 1:
            yield first, numbers
            first, numbers, n = i + 1, [], 0


def matches(numbers: list[np.ndarray], block: TestBlock) -> Iterator[tuple[int, int, int, int, int]]:
    """Longest matches in one shard: text, item, its word, first word, word after the last."""
    sizes = np.array([len(x) for x in numbers], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    shard = np.zeros(int((sizes + 1).sum()), np.int64)
    for b, x in zip(begin, numbers, strict=True):
        shard[b : b + len(x)] = x
    which, at, length = search(shard, block)
    for d, w, a, n in zip(np.searchsorted(begin, at, "right") - 1, which, at, length, strict=True):
        start = int(a - begin[d])
        yield int(d), int(block.owner[w]), int(block.place[w]), start, start + int(n)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_words: int = 2_000_000, shard_words: int = 500_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, items, spans.

    ``spans``: longest verbatim matches of at least ``window`` words (or a whole shorter item):
    item_id, word offset in the item, word range in the document. ``items``: their item_ids,
    distinct, sorted as strings. ``n_hit``: document words inside any of them.

    Test items come in blocks of some ``max_block_words`` words; of several blocks each reads the
    documents once more and adds the rows it hits. Null texts have no words; an item without words never
    occurs; a null item_id counts as the empty string. Repeated documents each get a row, repeated items
    count by their id. Empty tables give an empty table or no hits; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))

    def judged(held: Broadcast) -> DataFrame:
        def shards(it):
            block = held.value
            for batch in it:
                for first, numbers in numbered(batch.column(2), block, shard_words):
                    spans: list[list] = [[] for _ in numbers]
                    for d, item, place, start, end in matches(numbers, block):
                        spans[d].append({"item_id": block.names[item], "item_start": place, "start": start, "end": end})
                    part = batch.slice(first, len(numbers))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in numbers], pa.int64()), pa.array(spans, kind)], ["doc_id", "row", "n_words", "spans"])

        return rows.mapInArrow(shards, f"doc_id long, row long, n_words long, spans {SPAN}")

    hits = None
    for held, last in blocks_of(benchmark, window, max_block_words):
        if hits is None:
            out = judged(held) if last else written(judged(held), "block")
            hits = out.where(F.size("spans") > 0).select("doc_id", "row", "spans")
            single = last
        else:
            more = judged(held).where(F.size("spans") > 0).select("doc_id", "row", "spans")
            hits = hits.union(more if last else written(more, "block"))
    if not single:
        # rows that repeat doc_id and text have the same hits
        hits = hits.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("all"))
        on = F.col("o.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("o.row") == F.col("h.row"))
        out = out.alias("o").join(hits.alias("h"), on, "left").select("o.doc_id", "n_words", F.coalesce("all", "spans").alias("spans"))
    return out.select("doc_id", "n_words", covered("spans").alias("n_hit"), F.array_sort(F.array_distinct("spans.item_id")).alias("items"), "spans")


def covered(spans: str):
    """Words inside the union of the spans."""
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["to"], s["a"].cast("long")))).alias("n"),
        F.greatest(acc["to"], s["b"].cast("long")).alias("to"),
    )
    return F.aggregate(ends, zero, step, lambda acc: acc["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_words: int = 2_000_000, shard_words: int = 500_000) -> DataFrame:
    """``docs`` without the rows that hold a test passage, judged one by one while they are read; nothing
    is shuffled. Between several blocks of the test set what is left is written down.

    Null and empty texts hold no passage and stay; rows that repeat a doc_id are judged by their own
    texts; an empty table stays empty; other columns are kept as they are.
    """
    schema = docs.schema
    for held, last in blocks_of(benchmark, window, max_block_words):

        def clean(it, held=held):
            block = held.value
            for batch in it:
                stay = np.ones(batch.num_rows, bool)
                for first, numbers in numbered(batch.column("text"), block, shard_words):
                    stay[[first + d for d, *_ in matches(numbers, block)]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(clean, schema)
        docs = docs if last else written(docs, "block")
    return docs

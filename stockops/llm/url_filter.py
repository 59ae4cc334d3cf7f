"""URL filter: all glob rules at once by a bit-parallel wildcard automaton.

Every rule is compiled into a run of bits: one start state and one state for each literal. ``*``
gives the state before it a self-loop, ``?`` accepts any byte. The runs of all rules are packed into
as many 64-bit words as they need, and one Shift-And step for each byte of the canonical URL moves
all rules at once: ``D = (shift(D) & B[byte]) | (D & loops)``. URLs of an Arrow batch are simulated
side by side, longest first, so each step works on one contiguous block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Stands between host and path in globs; in the canonical URL a byte that UTF-8 never uses, so no path can forge a host.
BAR, CUT = "\x01", b"\xff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def signs(pattern: str) -> Iterator[int | slice | None]:
    """A glob as bytes; any byte for ``?``, none for ``*``, the cut for a byte of one. A backslash takes the
    next sign as it is."""
    plain = False
    for c in encoded(pattern):
        if not plain and c == 0x5C:
            plain = True
            continue
        yield c if plain else {0x2A: None, 0x3F: slice(0, 0xFF), ord(BAR): ord(CUT)}.get(c, c)
        plain = False


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def literal(text: str) -> str:
    return re.sub(r"([*?\\\x01])", r"\\\1", text)


class Globs:
    """Shift-And masks of anchored glob patterns over bytes."""

    def __init__(self, patterns: Sequence[str]):
        runs = [list(signs(p)) for p in patterns]
        words = max(1, -(-sum(1 + sum(c is not None for c in run) for run in runs) // 64))
        self.words, self.finals = words, []
        step, loops, start = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        at = 0
        for run in runs:
            bit = lambda k: (k >> 6, np.uint64(1 << (k & 63)))
            w, b = bit(at)
            start[w] |= b
            for c in run:
                if c is None:
                    w, b = bit(at)
                    loops[w] |= b
                    continue
                at += 1
                w, b = bit(at)
                step[c, w] |= b
            self.finals.append(at)
            at += 1
        self.step, self.loops, self.start = step, loops, start

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: url by pattern."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        state = np.tile(self.start, (n, 1))
        active = n
        for t in range(int(left[0]) if n else 0):
            active = int(np.searchsorted(-left[:active], -t, side="left"))
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[flat[begin[:active] + t]]) | (now & self.loops)
        out = np.zeros((n, len(self.finals)), bool)
        for k, f in enumerate(self.finals):
            out[order, k] = (state[:, f >> 6] >> np.uint64(f & 63)) & np.uint64(1) == 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` or the end, ASCII lower case; path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    globs: Sequence[str] = (),
    default: str = "allow",
) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains if the url's path
    starts with the rule's path; the longest one wins, of equally long ones the first listed. Where none
    fits, rule is null and the verdict is block if any of ``globs`` matches a dot, the host, the cut and the
    path, else ``default``. Rules hold no glob signs; in globs ``*`` stands for any bytes, ``?`` for one of host
    or path, a byte of one (``\\x01``) for the cut, and a backslash takes the next sign as it is. A byte of one
    in a path is a byte like any other. Rules and globs are parameters of the call and travel in
    the task's closure.

    Null urls and urls without ``://`` have empty host and path, which no rule fits. Repeated rows
    each get a row; an empty table gives an empty table; other columns are ignored.
    """
    rules = list(rules)
    globs = list(globs)
    names = [f"{h}{p}" for _, h, p in rules]
    lengths = np.array([len(x) for x in names] or [0])

    def batches(it):
        # longest first, so the first bit that is set is the rule that wins
        order = np.argsort(-lengths, kind="stable")[: len(rules)]
        table = Globs([f"*.{literal(rules[k][1])}{BAR}{literal(rules[k][2])}*" for k in order] + globs)
        for batch in it:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fits = table.match([b"." + encoded(h) + CUT + encoded(p) for h, p in zip(hosts, paths, strict=True)])
            mine, rest = fits[:, : len(rules)], fits[:, len(rules) :].any(1)
            best = [int(order[k]) if hit else None for k, hit in zip(mine.argmax(1) if rules else [0] * len(hosts), mine.any(1), strict=True)]
            rule = [None if k is None else names[k] for k in best]
            verdict = [rules[k][0] if k is not None else "block" if other else default for k, other in zip(best, rest, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(batches, "page_id long, host string, path string, rule string, verdict string")

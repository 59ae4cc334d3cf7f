"""Corpus operators against brute force, with nulls, ties, repeats, long and empty texts, empty
tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as h  # noqa: E402

from stockops.llm import decontaminate, exact_dedup, mixing, paragraphs, pii, quality, sharding, simhash, toxicity, url_filter  # noqa: E402
from stockops.llm.common import connected_components, maybe_among  # noqa: E402

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(text, n, rng=RNG):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


BASE = prose(300)
ROWS = (
    [(i, prose(RNG.randrange(1, 80)), "a") for i in range(60)]
    + [(100 + i, BASE, "b") for i in range(5)]
    + [(110 + i, changed(BASE, 1), "b") for i in range(12)]
    + [(130, "", "c"), (131, None, "c"), (132, "  \n", None), (133, "one", None), (134, "One", "c"), (133, "one", None)]
    + [(140, " ".join([BASE] * 100), "d"), (141, "Çà É \U0001f600 " + prose(5), "d")]
)


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names operators use themselves
    d = h.documents(spark, ROWS)
    return d.withColumns({c: F.lit("x") for c in ("fp", "node", "score", "kept", "size", "shard", "slot", "n_words", "spans", "copies", "text_hash", "h1", "base", "run", "digest")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


CONTRACT = {"width": 3, "lanes": 1, "group_bits": 32, "radius": 1, "max_distance": 3}


def test_simhash_is_exact(docs, empty):
    got = simhash.near_duplicates(docs, **CONTRACT).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
    assert len(got) == len(ROWS)
    prints = [h.fingerprint(t) for _, t, _ in ROWS]
    roots = h.components(len(ROWS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = defaultdict(lambda: 10**9)
    for (i, _, _), r in zip(ROWS, roots, strict=True):
        least[r] = min(least[r], i)
    want = sorted((i, f"{f:016x}", least[r]) for (i, _, _), f, r in zip(ROWS, prints, roots, strict=True))
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicates(empty, **CONTRACT).isEmpty()


def test_popcount_grid_loses_no_link(spark):
    """Fingerprints at every distance around the bound, as nodes of their own."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40)
    fps = list(base)
    for x in base[:30]:
        for d in (1, 2, 3, 4):
            y = int(x)
            for bit in rng.choice(63, d, replace=False):
                y ^= 1 << int(bit)
            fps.append(y)
    nodes = spark.createDataFrame([(i, [int(f)]) for i, f in enumerate(fps)], "node long, fp array<long>")
    links = simhash.grid_links(nodes, 32, 1, 3)
    got = {r.id: r.component for r in connected_components(links).collect()}
    roots = h.components(len(fps), lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 3)
    assert [got.get(i, i) for i in range(len(fps))] == roots


def test_drop_near_duplicates(docs, empty):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 100 in ids and not {101, 102, 103, 104, 111, 115} & set(ids)
    assert set(range(60)) <= set(ids) and 141 in ids
    assert simhash.drop_near_duplicates(empty).isEmpty()
    nameless = docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.drop_near_duplicates(nameless).count() == 3


def test_drop_near_duplicates_judges_rows(spark):
    """Rows that repeat a doc_id with other texts all stay; equal rows and copies under any id go."""
    rng = random.Random(12)
    a, b, c, d = (prose(40, rng) for _ in range(4))
    rows = [(1, a, "s"), (1, b, "s"), (1, c, "s"), (2, d, "s"), (2, d, "t"), (3, b, "s"), (None, c, "s"), (None, d, "s"), (None, prose(40, rng), "s"), (4, None, "s"), (5, "", "s")]
    for most in (8 << 20, 0):
        kept = simhash.drop_near_duplicates(h.documents(spark, rows).withColumn("row", F.lit("x")), max_broadcast=most)
        assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == sorted([("1", a), ("1", b), ("1", c), ("2", d), ("None", rows[8][1])])
        assert [r.doc_id for r in kept.collect() if not r.text] == [4]


def test_drop_near_duplicates_meets_near_prints_in_the_grid(spark):
    """Copies with one word more, with a band that hardly any of them shares."""
    rng = random.Random(41)
    rows = []
    for i in range(20):
        w = [f"v{rng.randrange(3000)}" for _ in range(400)]
        rows += [(i, " ".join(w), "s"), (100 + i, " ".join([*w, "end"]), "s")]
    kept = simhash.drop_near_duplicates(h.documents(spark, rows), bands=1, rows=1000)
    assert {r.doc_id for r in kept.collect()} == set(range(20))


def test_drop_near_duplicates_around_the_threshold(spark):
    """Against all pairs: similarities from 0.7 to 0.95, short texts, a repeated line, a chain in blocks."""
    rng = random.Random(21)
    grams = lambda t: {" ".join(h.words(t)[i : i + 5]) for i in range(max(1, len(h.words(t)) - 4))}
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 60, 200]))]
        texts.append(base)
        for cut in (rng.uniform(0.05, 0.3), rng.uniform(0.18, 0.22)):
            texts.append(base[: round(len(base) * (1 - cut))])
    texts.append(texts[0] * 1 + ["x"] * 5)
    texts.append(texts[0] * 1 + ["x"] * 500)
    chain = [f"c{k}" for k in range(300)]
    texts += [chain[k : k + 200] for k in range(0, 100, 5)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    sets = [grams(t) for t in texts]
    want = h.components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    d = h.documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for options in ({}, {"block": 4}):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(d, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in simhash.drop_near_duplicates(d).collect()} == set(want)


def test_exact_dedup(docs, empty):
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
        groups = defaultdict(list)
        for i, t, _ in ROWS:
            groups[t or ""].append(i)
        want = []
        for t, ids in groups.items():
            sha, best = hashlib.sha256(t.encode()).hexdigest(), pick(ids)
            for k, i in enumerate(sorted(ids)):
                want.append((i, best, len(ids), i == best and sorted(ids).index(i) == k, sha))
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_dedup.exact_duplicates(empty).isEmpty()


def test_exact_dedup_without_ids(spark):
    d = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (None, "b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_duplicates(d, keep="largest").collect())
    assert got == [("1", "1", 2, True), ("None", "1", 2, False), ("None", "None", 2, False), ("None", "None", 2, True)]


BAD = ["idiot", "moron", "loser"]


def toxic_rows(n):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randrange(20, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad), 1))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_rows(600)
    d = h.documents(spark, rows)
    return d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_toxicity_on_held_out_rows(toxic):
    d, labels, lexicon = toxic
    got = toxicity.score(d, lexicon).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(got) > 100 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_disguises_and_odd_texts(spark, toxic, empty):
    _, _, lexicon = toxic
    plain = "w1 w2 w3 w4 w5 w6 w7 w8 "
    texts = ["1d1ot", "IDIOT", "m0r0n", "ⅿоrоn", "l0ser", "i​diot", "idiiiiot"]
    d = h.documents(spark, [(i, plain + t, "s") for i, t in enumerate(texts)] + [(100, plain, "s"), (101, "", "s"), (102, None, "s"), (103, "w9 " * 60_000, "s")])
    got = {r.doc_id: r.predicted for r in toxicity.score(d, lexicon).collect()}
    assert [got[i] for i in range(len(texts))] == [1] * len(texts) and [got[i] for i in (100, 101, 102, 103)] == [0] * 4
    assert toxicity.drop_toxic(d, lexicon).count() == 4
    assert toxicity.score(empty, lexicon).isEmpty()
    blank = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(d, blank).collect()} == {0}


def test_exception_phrases(spark, toxic):
    _, _, lexicon = toxic
    machine = lexicon.automaton()
    assert toxicity.describe(["w1", "ioser", "w2"], machine, set())[0] > 0
    assert toxicity.describe(["w1", "ioser", "w2"], machine, {("w1", "ioser")}) == [0.0, 0.0, 0.0]
    # a harmless phrase is learnt from clean texts that hold a lexicon word, and then clears such texts
    rows, labels = toxic_rows(600)
    rows = [(i, f"{t} sore loser cup" if i % 75 == 1 else t, s) for i, t, s in rows]
    again = toxicity.learn(h.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    assert ("sore", "ioser") in again.exceptions and ("ioser", "cup") in again.exceptions
    d = h.documents(spark, [(1, "w1 w2 w3 sore loser cup w4", "s"), (2, "w1 w2 w3 loser w4", "s")])
    assert {r.doc_id: r.predicted for r in toxicity.score(d, again).collect()} == {1: 0, 2: 1}


def test_aho_corasick_equals_plain_search():
    """Greatest weight of an entry at each word, by trying all entries at all words."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    for _ in range(60):
        weights = {}
        for _ in range(rng.randrange(0, 12)):
            weights[rng.choice([" {} ", " {}"]).format(word())] = round(rng.uniform(0.5, 4), 3)
        words = [word() for _ in range(rng.randrange(0, 40))]
        want = {}
        for i, w in enumerate(words):
            fit = [x for e, x in weights.items() if (e.endswith(" ") and e.strip() == w) or (not e.endswith(" ") and w.startswith(e[1:]))]
            if fit:
                want[i] = max(fit)
        assert toxicity.hits(words, toxicity.Lexicon(weights).automaton()) == want


def test_toxicity_of_rows_without_ids_and_of_clashing_columns(spark, toxic):
    _, _, lexicon = toxic
    d = spark.createDataFrame([(None, "w1 w2 idiot idiot w3", "x"), (None, "w1 w2 w3", "y"), (5, None, "z")], "doc_id long, text string, score string").withColumn("predicted", F.lit("p"))
    assert sorted((str(r.doc_id), r.predicted) for r in toxicity.score(d, lexicon).collect()) == [("5", 0), ("None", 0), ("None", 1)]
    kept = toxicity.drop_toxic(d, lexicon)
    assert kept.columns == d.columns and sorted(str(r.score) for r in kept.collect()) == ["y", "z"]
    assert toxicity.drop_toxic(d.where("false"), lexicon).isEmpty()


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules(spark):
    urls = ["http://www.Example.com/en/x", "https://a.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1?q#f", "http://x.net", "x.net/es/", None, "http://a.org/casino", "http://com", "HTTP://A.COM/?x", "http://ünï.net/es/" + "z" * 5000, "http://x.com:80/", "http://[::1]/a#b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, RULES, ["*casino*"]).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(h.LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(a + p), a + p, v) for v, a, p in RULES if f".{host}".endswith(f".{a}") and path.startswith(p)]
        want = max(fit)[1:] if fit else (None, "block" if "casino" in host + path else "allow")
        assert got[i] == (host, path, *want), u
    assert url_filter.judge_urls(pages.where("false"), RULES).isEmpty()


def test_hundreds_of_url_rules_ties_and_literal_signs(spark):
    rng = random.Random(41)
    label = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    rules = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randrange(1, 3))), "/" + "/".join(label() for _ in range(rng.randrange(0, 3)))) for _ in range(300)]
    rules += [("block", "a", "/*"), ("allow", "b", "/\\x")]
    urls = [f"http://{'.'.join(label() for _ in range(rng.randrange(1, 4)))}/{'/'.join(label() for _ in range(rng.randrange(0, 4)))}" for _ in range(400)] + ["http://a/*", "http://a/zz", "http://b/\\x", "http://b/x"]
    globs = [f"*{label()}{label()}?{label()}*" for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    got = {(r.page_id, r.url): (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, globs).selectExpr("page_id", "concat('http://', host, path) AS url", "rule", "verdict").collect()}
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        path = "/" + path
        fit = [(-len(a + p), k, a + p, v) for k, (v, a, p) in enumerate(rules) if f".{host}".endswith(f".{a}") and path.startswith(p)]
        want = min(fit)[2:] if fit else (None, "block" if any(glob_matches(g, f".{host}\x01{path}".encode()) for g in globs) else "allow")
        assert got[i, u] == want, u
    assert (None, urls[0]) in got


def glob_matches(p, t):
    """Set of matched prefixes, one pattern sign at a time."""
    at = {0}
    for c in p:
        if c == "*":
            at = set(range(min(at), len(t) + 1)) if at else at
        else:
            at = {i + 1 for i in at if i < len(t) and (c == "?" or t[i : i + 1] == c.encode())}
    return len(t) in at


def test_globs_equal_plain_matching():
    rng = random.Random(5)
    patterns = ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["*", "", "?"]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))).encode() for _ in range(200)] + [b""]
    got = url_filter.Globs(patterns).match(texts)
    for k, p in enumerate(patterns):
        assert [glob_matches(p, t) for t in texts] == list(got[:, k]), p


def test_paths_cannot_forge_hosts(spark):
    rng = random.Random(8)
    signs = ["\x01", "\x00", "\x02", "\x7f", ".", "/", "x", "com", "é", "ÿ", "*", "?", "\\", "example.com", "/en/"]
    urls = ["http://evil.org/x.example.com\x01/en/a", "http://evil.org/x.com\x01/", "http://a.xxx/b", "http://evil.org/a.xxx\x01b", "http://x\x01y.com/z"]
    urls += ["http://" + "".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge_urls(pages, RULES, ["*.xxx\x01*", "*\x02\x01?*", "*\\\x01x*"]).collect()
    assert len(rows) == len(urls)
    for r in rows:
        fit = [(len(a + p), a + p, v) for v, a, p in RULES if f".{r.host}".endswith(f".{a}") and r.path.startswith(p)]
        bad = r.host.endswith(".xxx") or r.host == "xxx" or (r.host.endswith("\x02") and r.path) or "\x01x" in r.host or "\x01x" in r.path
        assert (r.rule, r.verdict) == (max(fit)[1:] if fit else (None, "block" if bad else "allow")), urls[r.page_id]


def test_decontamination(spark, docs, empty):
    rng = random.Random(11)
    items = [(i, prose(rng.randrange(1, 30), rng)) for i in range(12)] + [(50, "Tiny item"), (51, None), (52, ""), (12, prose(12, rng)), (12, prose(12, rng)), (60, "aa " * 25)]
    rows = []
    for k in range(40):
        w = prose(60, rng).split()
        for _ in range(k % 4):
            t = h.test_words(rng.choice(items)[1])
            cut = t[: rng.randrange(1, len(t) + 1)] if t else []
            at = rng.randrange(len(w))
            w[at:at] = cut
        rows.append((k, ", ".join(w), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "tiny ITEM", "s"), (102, "tiny ITEM", "s"), (103, "aa " * 400 + "é " + "aa " * 15, "s"), (104, "a1-b2 " * 30_000, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    for block_words in (1_000_000, 200):
        found = decontaminate.contamination(h.documents(spark, rows).withColumn("spans", F.lit("x")), bench, max_block_words=block_words, shard_words=500)
        got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect())
        want = []
        for i, text, _ in rows:
            w = h.test_words(text)
            hit, names = set(), set()
            for name, t in items:
                t = h.test_words(t)
                n = min(10, len(t))
                grams = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} if t else set()
                for k in range(len(w) - n + 1):
                    if n and tuple(w[k : k + n]) in grams:
                        hit |= set(range(k, k + n))
                        names.add(str(name))
            want.append((i, len(w), len(hit), sorted(names)))
        assert got == sorted(want)
    assert decontaminate.contamination(empty, bench).isEmpty()
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").isEmpty()
    for block_words in (1_000_000, 200):
        left = decontaminate.drop_contaminated(h.documents(spark, rows), bench, max_block_words=block_words)
        assert sorted(r.doc_id for r in left.collect()) == sorted(x[0] for x in want if x[2] == 0)
    assert decontaminate.drop_contaminated(empty, bench).isEmpty()


def test_decontamination_judges_rows(spark):
    leak = prose(12)
    d = h.documents(spark, [(1, leak, "a"), (1, prose(20), "b"), (None, leak, "c"), (None, prose(20), "d"), (2, None, "e")]).withColumn("n_words", F.lit("x"))
    bench = spark.createDataFrame([(None, leak), (3, None)], "item_id long, text string")
    assert sorted(r.source for r in decontaminate.drop_contaminated(d, bench).collect()) == ["b", "d", "e"]
    got = decontaminate.contamination(d, bench).collect()
    assert sorted((str(r.doc_id), r.n_hit, tuple(r["items"])) for r in got) == [("1", 0, ()), ("1", 12, ("",)), ("2", 0, ()), ("None", 0, ()), ("None", 12, ("",))]


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, [1.0] * 24).collect()
    assert len(got) == len(ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.assign_shards(empty, [1.0] * 24).isEmpty()


def test_sharding_without_ids_and_of_whole_rows(spark, docs, empty):
    d = h.documents(spark, [(None, f"t{i}", "s") for i in range(50)] + [(7, "same", "s")] * 50).withColumns({"nr": F.lit("x"), "bucket": F.lit("y")})
    got = sharding.assign_shards(d, [1.0] * 5, rows_per_bucket=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sharding.sharded_documents(docs.drop("shard"), [1.0] * 24)
    assert whole.columns == [*docs.drop("shard").columns, "shard"]
    law = {r.doc_id: r.shard for r in sharding.assign_shards(docs, [1.0] * 24).collect()}
    assert all(r.shard == law[r.doc_id] for r in whole.collect()) and whole.count() == len(ROWS)
    assert sharding.sharded_documents(empty, [1.0] * 24).isEmpty()


def test_rendezvous_weights(spark):
    n = spark.range(20_000).select(F.col("id").alias("doc_id"))
    share = {r.s: r["count"] / 20_000 for r in n.select(sharding.rendezvous(F.col("doc_id"), [1.0, 2.0, 0.0, 1.0]).alias("s")).groupBy("s").count().collect()}
    assert set(share) == {0, 1, 3} and abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card":
                total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            if name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, name, m.end()))
    return ",".join(f"{n}:{a}:{e}" for a, _, n, e in sorted(out))


def test_base_spans(spark, empty):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a.b", "@", "x@y.z", "1.2.3.4", "256", ".", "0", "4111 1111 1111 1111", "+1 (234) 567-8901", " ", "-", "_", "é", "😀", "7", "12"]) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += [None, "", "a@b", "x@y.z_foo@bar.com", "1.2.3.4.5.6.7.8", "001.002.3.4", "+" * 50, "9" * 5000, "a" * 50_000 + "@b.c", "4111-1111-1111-1111 4111 1111 1111 1112", "+12 3456789", "1" * 30 + "." + "2.3.4"]
    d = h.documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumns({c: F.lit("x") for c in ("base", "near", "text_hash")})
    got = {r.doc_id: r.s for r in pii.personal_data(d).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert all(got[i] == base_spans(t) for i, t in enumerate(texts))
    assert pii.personal_data(empty).isEmpty()


def test_revealing_terms_are_removed(spark):
    rows = [(i, f"{prose(6)} agent Zorblax wrote. {prose(60)} Write to boss@corp.example today {i}", "s") for i in range(8)]
    rows += [(100 + i, f"today {prose(20)} agent {i}", "s") for i in range(200)] + [(500 + i, "copy Quux me@x.y copy", "s") for i in range(9)]
    d = h.documents(spark, rows)
    got = {r.doc_id: [(s["kind"], s["value"]) for s in r.extra] for r in pii.personal_data(d).collect()}
    assert all(("removed", "zorblax") in got[i] for i in range(8))
    assert all(not got[i] for i in range(100, 300)) and all(not got[500 + i] for i in range(9))
    clean = {r.doc_id: r.clean_text for r in pii.sanitize(d).collect()}
    assert "Zorblax" not in clean[0] and "[EMAIL]" in clean[0] and "[...]" in clean[0] and clean[100] == rows[8][1]


def test_disclosure_equals_counts_over_texts(spark):
    """Spans of revealing terms against PMI by counting texts, with copies, null ids and repeated ids."""
    rng = random.Random(19)
    names, mails = [f"name{k}" for k in range(12)], [f"m{k}@x.y" for k in range(6)]
    texts = []
    for _ in range(300):
        w = prose(rng.randrange(5, 30), rng).split()
        if rng.random() < 0.4:
            k = rng.randrange(6)
            w.insert(rng.randrange(len(w)), mails[k])
            if rng.random() < 0.9:
                w.insert(rng.randrange(len(w)), names[k])
        if rng.random() < 0.05:
            w.insert(0, rng.choice(names))
        if rng.random() < 0.1:
            w.append("+1 234 567 8901")
        texts.append(" ".join(w))
    texts += texts[:40] + [None, ""]
    d = h.documents(spark, [(i % 250 if i % 7 else None, t, "s") for i, t in enumerate(texts)]).withColumns({"base": F.lit("x"), "extra": F.lit("y"), "n": F.lit(1)})
    for most in (8 << 20, 0):
        got = sorted((r.text_hash, ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.extra)) for r in pii.personal_data(d, max_broadcast=most).collect())
        different = sorted({t or "" for t in texts})
        skip = re.compile("|".join(p for _, p in PATTERNS) + r"|\w+")
        terms = {t: [(m[0].lower(), m.start(), m.end()) for m in skip.finditer(t) if re.fullmatch(r"\w{3,}", m[0])] for t in different}
        kinds = {t: {f"email:{m}" for m in mails if m in t.split()} | ({"email"} if "@" in t else set()) | ({"phone", "phone:+1 234 567 8901"} if "+1" in t else set()) for t in different}
        n, df_e, df_t, co = len(different), defaultdict(int), defaultdict(int), defaultdict(int)
        for t in different:
            for e in kinds[t]:
                df_e[e] += 1
            for w in set(re.findall(r"\w+", t.lower())):
                df_t[w] += 1
            for w in {x[0] for x in terms[t]}:
                for e in kinds[t]:
                    co[e, w] += 1
        tried = {p: c for p, c in co.items() if c >= 3 and df_e[p[0]] >= 3}
        told = {}
        for (e, w), c in tried.items():
            ic = np.log2(n / df_e[e])
            part = np.log2(n * c / (df_t[w] * df_e[e])) / ic
            if part >= 0.85 and c * ic >= np.log2(len(tried) / 0.01):
                told[e, w] = "removed" if part >= 0.95 else "widened"
        want = []
        for t in texts:
            t = t or ""
            spans = []
            for w, a, b in terms[t]:
                acts = [told[e, w] for e in kinds[t] if (e, w) in told]
                if acts:
                    spans.append((a, f"{min(acts)}:{a}:{b}"))
            want.append(",".join(s for _, s in sorted(spans)))
        assert sorted(s for _, s in got) == sorted(want) and sum(map(bool, want)) > 50


def test_quality(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        text = ". ".join(prose(rng.randrange(5, 12), rng).capitalize() for _ in range(rng.randrange(3, 20))) + "." if good else " ".join(w + rng.choice(["###", "$$$", "|"]) for w in prose(rng.randrange(5, 60), rng).split())
        rows.append((i, text, f"s{i % 3}" if good else "junk"))
        if i < 300:
            labels.append((i, int(good)))
    d = h.documents(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows_ = quality.views(d, lab)
    model = quality.learn(rows_)
    got = quality.score(rows_, model).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 500 and len(held) > 80 and sum((r.predicted == 1) == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    odd = h.documents(spark, [(1, None, None), (2, "", "s1"), (None, "x " * 50_000, "s1"), (1, "again", "s2")]).withColumns({"y": F.lit("x"), "fold": F.lit("y"), "a": F.lit("z")})
    scores = quality.score(quality.views(odd.drop("n_chars"), lab), model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(quality.views(empty, lab), model).isEmpty() and quality.learn(quality.views(empty, lab)) is None
    good = quality.views(d, lab.where("quality = 1"))
    assert {r.score for r in quality.score(good, quality.learn(good)).collect()} == {0.5}


def test_quality_fits_equal_fits_on_one_machine(spark):
    """Sums over tasks give the coefficients that one pass over all rows in memory gives."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(300, 2))
    y = (a[:, 0] + b[:, 1] + rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(i, float(y[i]), i % 5, a[i].tolist(), b[i].tolist()) for i in range(300)], "doc_id long, y double, fold int, a array<double>, b array<double>").repartition(7)
    got = quality.fitted(rows, lambda y, fold, a, b: [(a, y), (b, y)], [np.zeros(4), np.zeros(3)], 0.1, 30)
    for w, x in zip(got, (a, b), strict=True):
        x1 = np.column_stack([np.ones(300), x])
        slope = x1.T @ (y - 1 / (1 + np.exp(-(x1 @ w)))) - np.append(1e-4, np.full(x.shape[1], 0.1)) * w
        assert np.abs(slope).max() < 1e-4


def test_co_training_tells_the_other_view():
    """Rows a view is sure of are told to the other one, once, by the round that met them first."""
    z = np.array([[-3.0], [-1.0], [0.0], [4.0], [9.0]])
    first = quality.Round((np.array([0.0, 1.0]), np.array([0.0, 1.0])), ((-2.0, 5.0), (-30.0, 30.5)))
    then = quality.Round((np.array([0.0, 1.0]), np.array([0.0, 1.0])), ((-30.0, 30.5), (-0.5, 3.0)))
    free = np.array([True, True, True, True, True])
    labels, left = quality.told([first, then], z, z, free)
    assert labels[1].tolist() == [0, -1, -1, -1, 1] and labels[0].tolist() == [-1, 0, -1, 1, -1] and left.tolist() == [False, False, True, False, False]
    labels, left = quality.told([first], z, z, np.zeros(5, bool))
    assert not left.any() and all((x == -1).all() for x in labels)


def test_repeated_passages(spark, empty):
    rng = random.Random(4)
    sentence = lambda n: prose(n, rng).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(6))
    line = prose(60, rng)
    near = changed(line, 1, rng)
    rows = [(i, " ".join(sentence(9) for _ in range(8)), "s") for i in range(40)]
    rows += [(100 + i, f"{prose(7, rng)} {passage} {prose(5, rng)}", "s") for i in range(6)]
    rows += [(200, f"a\n{line}\nb", "s"), (201, f"c\n{near}", "s"), (202, line.upper(), "s")]
    own = prose(40, rng)
    rows += [(300, None, "s"), (301, "", "s"), (302, "short.", "s"), (303, "short.", "s"), (None, passage, "s"), (310, f"{own}\n{prose(9, rng)}\n{own}", "s")]
    for options in ({}, {"block": 2, "max_broadcast": 0}):
        got = paragraphs.repeated_passages(h.documents(spark, rows).withColumn("keys", F.lit(1)), **options).collect()
        assert {r.doc_id for r in got} == {100 + i for i in range(6)} | {200, 201, 202, None}
        classes = defaultdict(set)
        for r in got:
            classes[r.class_id].add(r.doc_id)
        assert {200, 201, 202} in classes.values()
        assert {r.doc_id for r in got if not r.removed} == {100, 200}
        assert all(r.first_doc_id == (200 if (r.doc_id or 100) >= 200 else 100) for r in got)
        assert all(r.n_words >= 40 for r in got)
    assert paragraphs.repeated_passages(empty).isEmpty()


def test_repeated_passages_keep_rows_of_one_id_apart(spark):
    rng = random.Random(14)
    a, b = prose(60, rng), prose(60, rng)
    rows = [(1, f"{prose(20, rng)} {a}", "s"), (1, f"{b} {prose(20, rng)}", "s"), (2, f"{prose(9, rng)} {a}", "s"), (3, f"{prose(9, rng)} {b}", "s"), (4, a, "s"), (4, a, "s")]
    got = paragraphs.repeated_passages(h.documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.removed) for r in got if r.n_words > 30) == [(1, 1, False), (1, 1, False), (2, 1, True), (3, 1, True), (4, 1, True)]
    alone = paragraphs.repeated_passages(h.documents(spark, [(4, a, "s"), (4, a, "s"), (5, b, "s")]))
    assert alone.isEmpty()


@pytest.mark.parametrize("joint", [" ", "\n", ". ", " - "])
def test_repeated_passages_against_all_runs_of_words(spark, joint):
    """Verbatim passages of 51 words and more, pasted anywhere, over lines of any length: each document
    that shares such a run with another one is found, and none that shares fewer than 12 words is."""
    rng = random.Random(33)
    wide = [f"v{i}" for i in range(5000)]
    text = lambda n: [rng.choice(wide) for _ in range(n)]
    passages = [text(rng.randrange(51, 90)) for _ in range(8)] + [text(rng.randrange(3, 10)) for _ in range(8)]
    rows = []
    for i in range(120):
        w = text(rng.randrange(40, 200))
        if i % 3:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages)
        every = rng.choice([4, 7, 30, 1000])
        rows.append((i, joint.join(" ".join(w[k : k + every]) for k in range(0, len(w), every)), "s"))
    runs = defaultdict(lambda: defaultdict(set))
    for n in (12, 51):
        for i, t, _ in rows:
            w = [x for x in h.words(t) if x not in ".-"] if joint == " - " else h.words(t)
            for k in range(len(w) - n + 1):
                runs[n][tuple(w[k : k + n])].add(i)
    shared = {n: {i for ids in runs[n].values() if len(ids) > 1 for i in ids} for n in runs}
    found = {r.doc_id for r in paragraphs.repeated_passages(h.documents(spark, rows), min_passage=35).collect()}
    if joint in (" ", "\n"):
        assert found >= shared[51] and found <= shared[12]
        assert len(shared[51]) > 30


def test_lines_with_near_copies_equal_all_pairs(spark):
    """Classes of lines are the components of exact Jaccard over all pairs of lines."""
    rng = random.Random(8)
    lines = [[f"v{rng.randrange(10**6)}" for _ in range(rng.choice([8, 20, 60]))] for _ in range(30)]
    for base in list(lines):
        for cut in (rng.uniform(0.02, 0.3), 0.2):
            lines.append(base[: max(8, round(len(base) * (1 - cut)))])
    lines = [" ".join(x) for x in lines]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in lines]
    want = h.components(len(lines), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = h.documents(spark, [(i, t, "s") for i, t in enumerate(lines)])
    units = paragraphs.units(docs, 8, 4, 4, 5, 40, 3).where("is_line").withColumnRenamed("h", "id")
    nodes = units.groupBy("id").agg(F.first("keys").alias("keys"))
    for block, most in ((1000, 1 << 20), (3, 0)):
        got = {r.id: r.component for r in paragraphs.line_classes(nodes, units.select("id", "doc_id", "row", "start", "end"), docs, 5, 0.8, block, most).collect()}
        ids = {r.doc_id: r.id for r in units.collect()}
        classes, named = defaultdict(set), defaultdict(set)
        for i in range(len(lines)):
            classes[want[i]].add(ids[i])
            named[got.get(ids[i], ids[i])].add(ids[i])
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, named.values()))


def test_banding_recall():
    """Bands of the default settings catch nearly all pairs at the threshold."""
    rng = np.random.default_rng(1)
    hit = 0
    with np.errstate(over="ignore"):
        for _ in range(600):
            shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
            x, y = (paragraphs.band_keys(np.concatenate([shared, own]), np.zeros(1, np.int64), 10, 4)[0] for own in (a, b))
            hit += bool((x == y).any())
    assert hit >= 588


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportionment(spark, seats):
    rng = random.Random(seats)
    votes = [rng.random() * 10 ** rng.randrange(0, 5) for _ in range(25)] + [0.0]
    t = spark.createDataFrame([(f"{i:02d}", v, seats) for i, v in enumerate(votes)], "source string, votes double, seats long")
    got = {r.source: r.quota for r in mixing.apportion(t, [], ["source"]).collect()}
    assert [got[f"{i:02d}"] for i in range(26)] == sainte_lague(votes, seats)


def test_mixed_documents_are_what_is_taken(spark, docs):
    """Copies of each row are its taken words over its size, rounded; texts are never cut."""
    rng = random.Random(23)
    rows = [(i, prose(rng.randrange(1, 30), rng), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(None, "no id here", "b")] * 3 + [(5, "again", "a")] * 4 + [(900, None, "a"), (901, "", "b")]
    d = h.documents(spark, rows).withColumns({"at": F.lit("x"), "shard": F.lit("y"), "copies": F.lit("z")})
    for options in ({}, {"rows_per_shard": 20, "group": 3, "max_block": 4}):
        taken = defaultdict(float)
        for r in mixing.mix(d, **options).collect():
            taken[r.doc_id] += r.taken / max(1, r.size)
        copies = defaultdict(int)
        out = mixing.mixed_documents(d, **options)
        assert out.columns == d.columns
        for r in out.collect():
            copies[r.doc_id] += 1
        assert all(abs(taken[i] - copies[i]) <= (0.5 if i not in (None, 5) else 4) for i in {*taken, *copies}) and not copies[900]
        assert sum(abs(taken[i] - copies[i]) for i in taken) < 40


def test_runs_of_one_word_are_no_pairs():
    """An item of n equal words in a text of 5n: matches are linear in n, whatever their length."""
    n = 20_000
    block = decontaminate.TestBlock([("i", [b"a"] * n)], 10)
    found = list(decontaminate.matches([np.ones(5 * n, np.int64)], block))
    assert len(found) < 7 * n and max(e - s for _, _, _, s, e in found) == n and {0, 5 * n} <= {x for f in found for x in f[3:]}


def test_common_words_equal_plain_steps():
    rng = random.Random(12)
    a, b = (np.array([rng.choice([0, 1, 1, 1, 1, 2, 2]) if k % 60 > 9 else 1 for k in range(400)]) for _ in range(2))
    b[50:300] = a[20:270]
    i, j = np.array([rng.randrange(400) for _ in range(500)] + [20]), np.array([rng.randrange(400) for _ in range(500)] + [50])

    def steps(x, y):
        n = 0
        while x + n < 400 and y + n < 400 and a[x + n] == b[y + n] and a[x + n]:
            n += 1
        return n

    assert decontaminate.common_words(a, i, b, j).tolist() == [steps(x, y) for x, y in zip(i, j, strict=True)]


def test_mixed_documents_of_long_rows(spark):
    """A long row may stand at both ends of its run: it is judged by what both take of it."""
    for n in range(2):
        rows = [(n * 100 + i, "w " * (30_000 if i == 0 else 400), "a") for i in range(5)] + [(n * 100 + 50, "v " * 2_000, "b")]
        d = h.documents(spark, rows)
        taken = {r.doc_id: r.taken / r.size for r in mixing.mix(d, weights=(1, 1), seed=n).collect()}
        copies = defaultdict(int)
        for r in mixing.mixed_documents(d, weights=(1, 1), seed=n).collect():
            copies[r.doc_id] += 1
        assert all(abs(taken[i] - copies[i]) <= 0.5 for i in taken), (taken, copies)


def test_mixed_words_of_small_documents_meet_the_targets(spark):
    rng = random.Random(31)
    d = h.documents(spark, [(i, prose(rng.randrange(5, 15), rng), "abc"[min(2, i % 7)]) for i in range(6_000)])
    want = {r.source: r.taken for r in d.join(mixing.mix(d), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(d).select("source", "text").collect():
        got[r.source] += len(h.words(r.text))
    assert all(abs(got[s] - want[s]) <= 0.01 * want[s] for s in want)


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in ROWS:
        size[s] = size.get(s, 0) + len(h.words(t))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, total = {}, sum(size.values())
    capped = set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = [s for s in open_ if target[s] > 3 * size[s]]
        if not over:
            break
        capped |= set(over)
    of = {}
    for i, t, s in ROWS:
        of[i] = s
    taken = defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 + 0.002 * target[s] for s in names)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in again) == sorted((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mix(empty).isEmpty()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and abs(sum(len(h.words(r.text)) for r in mixed.select("text").collect()) - total) < 0.5 * total


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    linked = {frozenset(p) for p in pairs if None not in p}
    ids = sorted({x for p in linked if len(p) == 2 for x in p})
    roots = h.components(len(ids), lambda i, j: frozenset((ids[i], ids[j])) in linked)
    assert got == {x: ids[r] for x, r in zip(ids, roots, strict=True)}


def test_crowded_cells_are_dealt_out(spark):
    """A cell that holds most fingerprints is worked on in blocks, and no link is lost."""
    rng = random.Random(77)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {base[0]}
    while len(fps) < 500:
        f = base[0] if len(fps) < 400 else rng.choice(base)
        for _ in range(rng.randrange(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    roots = h.components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    nodes = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)], "node long, fp array<long>")
    for block in (30, 16_000):
        found = connected_components(simhash.grid_links(nodes, 32, 1, 3, block))
        got = {r.id: r.component for r in found.collect()}
        assert [got.get(i, i) for i in range(len(fps))] == roots


def test_chance_does_not_chain_candidates(spark, monkeypatch):
    """Texts of two shingles have fingerprints of few set bits, a third of which are within the distance of candidates
    by chance: unrelated ones are not candidates, so components of candidates do not grow with the square of the table."""
    rng = random.Random(55)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)), "s") for i in range(3000)]
    rows += [(5000 + i, t + (" end" if i % 2 else ""), "s") for i, t, _ in rows[:20]]
    asked, read = [], simhash.shingle_sets
    monkeypatch.setattr(simhash, "shingle_sets", lambda docs, wanted, *a: (asked.append(wanted.count()), read(docs, wanted, *a))[1])
    kept = {r.doc_id for r in simhash.drop_near_duplicates(h.documents(spark, rows)).collect()}
    # equal texts are one set; two of three shingles are no near copy
    assert kept == set(range(3000)) | set(range(5001, 5020, 2)) and asked[0] <= 40


def test_few_rows_may_be_among_the_keys(spark):
    """No key is lost, with or without an id, and hardly any other row is taken for one."""
    df = spark.range(40_000).select(F.when(F.col("id") % 1000 > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("row"))
    keys = df.where("row % 8 = 0")
    got = maybe_among(df, ["doc_id", "row"], keys, 8 << 20)
    assert got.columns == [*df.columns, "maybe"] and got.count() == 40_000
    assert got.where("maybe and row % 8 = 0").count() == keys.count()
    assert got.where("maybe and row % 8 <> 0").count() < 40_000 / 10
    assert maybe_among(df, ["doc_id", "row"], keys, 0).where("maybe and row % 8 = 0").count() == keys.count()
    assert maybe_among(df, ["doc_id", "row"], keys.limit(0), 0).where("maybe").isEmpty()

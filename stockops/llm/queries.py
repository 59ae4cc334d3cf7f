"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, conversation_trie, decontaminate, exact_dedup, mixing, neighbours, paragraphs, pii, quality, sharding, simhash, toxicity, url_filter
from .common import held_out, read_table

#: Rules and wildcard patterns of the registered URL query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL_GLOBS = ["*casino*", "*pills*", "*free-bets*", "*ads-track*", "*.xxx\x01*"]
N_SHARDS = 24


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, lanes=1, group_bits=32, radius=1, max_distance=3)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), [1.0] * N_SHARDS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "extra")).alias("spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.views(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.score(rows, quality.learn(rows))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a passage of over 50 words is seen as one of 35 at least: up to 8 words at each end lie in incomplete pieces
    return paragraphs.repeated_passages(read_table(spark, sf_dir, "documents"), min_passage=35)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_nodes(read_table(spark, sf_dir, "conversations"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.cluster(read_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_toxicity, op4_url_filter, op5_decontaminate, op6_sharding, op7_pii, op8_quality, op9_substring_dedup, op10_mixing, op11_conversation_trie, op12_neighbours, op13_centroids)
}

#: CRC-32 of a decimal id in SQL: bytes after the start value, eight steps for each byte.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)



def _lloyd(rounds: int = 5, k: int = 40) -> str:
    """SQL of the registered clustering: one pair of tables a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS (SELECT x.rid, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c USING (i) GROUP BY x.rid, c.c),
        a{r} AS (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS rn FROM d{r}) WHERE rn = 1)""")
        if r < rounds:
            steps.append(f"""
        m{r} AS (SELECT a.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{r} a JOIN x USING (rid) GROUP BY a.c, x.i),
        c{r + 1} AS (SELECT c, i, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c{r}.x) AS x FROM c{r} LEFT JOIN m{r} m USING (c, i))""")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
        x AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(v) AS x FROM v),
        c0 AS (SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL) WHERE c < {k}),
        {",".join(steps)},
        names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} a JOIN v USING (rid) JOIN names USING (c)"""


ORACLES: dict[str, str] = {
    "op13_centroids": _lloyd(),
    "op12_neighbours": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT rid, len(e) AS dims, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM v
              WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_max(list_transform(e, lambda x: abs(x))) > 0),
        links AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.dims = b.dims AND a.rid <> b.rid WHERE a.e = b.e OR list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(rid, place) AS (SELECT rid, rid FROM v UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.place),
        part AS (SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.place GROUP BY reach.rid),
        n AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN part USING (rid) LEFT JOIN n USING (rid)""",
    "op11_conversation_trie": f"""
        WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, {_CRC} % 6 AS h,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, h FROM o),
        parts AS (SELECT c.conv_id, 0 AS part, pos AS place, role, text FROM convs c JOIN o ON o.conv_id = base AND pos <= c.h
                  UNION ALL SELECT conv_id, 1, pos, role, text FROM o WHERE pos > h),
        r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, sha256(role || chr(0) || text) AS turn, length(text) AS n FROM parts),
        p AS (SELECT conv_id, depth, n, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM r
              UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
        node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved FROM p GROUP BY depth, prefix),
        m AS (SELECT p.conv_id AS member, node.* FROM p JOIN node USING (depth, prefix)),
        tree AS (SELECT node.conv_id, node.depth, node.n_convs, node.saved, node.prefix, up.conv_id AS parent_conv_id FROM node LEFT JOIN m up ON up.member = node.conv_id AND up.depth = node.depth - 1),
        kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL),
        sums AS (SELECT up.depth, up.conv_id, sum(t.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
                 FROM tree t LEFT JOIN kids k USING (depth, conv_id) JOIN m up ON up.member = t.conv_id AND up.depth <= t.depth GROUP BY up.depth, up.conv_id),
        ends AS (SELECT depth, prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN last USING (conv_id, depth) GROUP BY depth, prefix)
        SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM tree t LEFT JOIN kids USING (depth, conv_id) JOIN sums USING (depth, conv_id) LEFT JOIN ends ON ends.depth = t.depth AND ends.prefix = t.prefix""",
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op4_url_filter": f"""
        WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES}),
        cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
              FROM cut),
        fit AS (SELECT u.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
                FROM u JOIN rules ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath) GROUP BY u.page_id)
        SELECT u.page_id, u.host, u.path, fit.rule,
               coalesce(fit.verdict, CASE WHEN regexp_matches('.' || host, 'casino|pills|free-bets|ads-track|[.]xxx$') OR regexp_matches(path, 'casino|pills|free-bets|ads-track') THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN fit USING (page_id)""",
    "op5_decontaminate": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
        bw AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS win
               FROM (SELECT item, words, unnest(range(1, greatest(len(words) - least(10, len(words)) + 2, 1))) AS i FROM b WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS win
               FROM (SELECT doc_id, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS i FROM w, sizes WHERE len(words) >= n)),
        hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY doc_id)
        SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}

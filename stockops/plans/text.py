"""Queries of corpus building, the chunk graph and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.durable import written
from ..operators import callgraph as cgr
from ..operators import corpus as c
from ..operators import graph as g
from ..operators import retrieval as r
from .registry import joined, query, r6


def lines(t):
    return c.lines_of(t.blocks.select("doc_id", "page_num", "block_id", "block_content"))


@query("c1_heading_carry", ["blocks"], r"""
, ln AS (SELECT doc_id, page_num, block_id, CAST(unnest(range(len(p))) AS INT) AS line_no, unnest(p) AS line FROM (SELECT *, string_split(block_content, chr(10)) AS p FROM blocks)),
hd AS (SELECT *, nullif(regexp_extract(trim(line), '^#+\s*([\dA-Z]+(?:\.[\dA-Z]+){0,2})\.?(?:\s+(.*))?$', 1), '') AS number FROM ln),
dp AS (SELECT *, len(string_split(number, '.')) AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_id, line_no) AS rn FROM hd),
ca AS (SELECT *, max(CASE WHEN depth = 1 THEN rn END) OVER w AS r1, max(CASE WHEN depth = 2 THEN rn END) OVER w AS r2, max(CASE WHEN depth = 3 THEN rn END) OVER w AS r3 FROM dp WINDOW w AS (PARTITION BY doc_id ORDER BY rn ROWS UNBOUNDED PRECEDING))
SELECT a.doc_id, a.block_id, a.line_no, a.number IS NOT NULL AS is_heading, h1.number AS section_number, CASE WHEN a.r1 IS NULL OR a.r2 > a.r1 THEN h2.number END AS subsection_number,
  CASE WHEN (a.r1 IS NULL OR a.r3 > a.r1) AND (a.r2 IS NULL OR a.r3 > a.r2) THEN h3.number END AS subsubsection_number
FROM ca a LEFT JOIN dp h1 ON h1.doc_id = a.doc_id AND h1.rn = a.r1 LEFT JOIN dp h2 ON h2.doc_id = a.doc_id AND h2.rn = a.r2 LEFT JOIN dp h3 ON h3.doc_id = a.doc_id AND h3.rn = a.r3""")
def c1(t):
    return c.heading_carry(lines(t)).select("doc_id", "block_id", "line_no", "is_heading", "section_number", "subsection_number", "subsubsection_number")


@query("c2_extract_references", ["blocks"], r"""
SELECT doc_id, block_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(replace(lower(block_content), '$', ''), 'example\s+([a-z\d]+\.\d+)', 1), lambda x: upper(x)))), ',') AS referenced_examples,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(replace(lower(block_content), '$', ''), '(?:equation|formula|eq\.)\s+\(?([a-z\d]+\.\d+)\)?', 1), lambda x: upper(x)))), ',') AS referenced_formulas FROM blocks""")
def c2(t):
    return c.extract_references(t.blocks, "block_content").select("doc_id", "block_id", joined("referenced_examples"), joined("referenced_formulas"))


@query("c3_chunk_text", ["blocks"], r"""
, bk AS (SELECT *, regexp_replace(block_content, '^\s+|\s+$', '', 'g') AS content, regexp_extract(block_content, '(?i)^\s*(exercise|example|algorithm)\s+([A-Z]?\d+\.\d+)', 1) AS named, regexp_extract(block_content, '(?i)^\s*(exercise|example|algorithm)\s+([A-Z]?\d+\.\d+)', 2) AS number FROM blocks
  WHERE block_label NOT IN ('header', 'footer', 'number', 'footnote', 'header_image', 'footer_image', 'aside_text')),
ty AS (SELECT *, starts_with(content, '#') AS heading, CASE WHEN starts_with(content, '#') THEN 'text' WHEN named <> '' THEN lower(named) WHEN block_label IN ('formula', 'table') THEN 'numbered_' || block_label ELSE 'text' END AS kind,
  CASE WHEN NOT starts_with(content, '#') AND named <> '' THEN upper(number) END AS entity, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_bbox[2], block_bbox[1], block_id) AS i FROM bk WHERE content <> ''),
ck AS (SELECT doc_id, i, 0 AS seq, kind AS chunk_type, entity AS entity_id, length(content) AS n_chars, 1 AS n_blocks FROM ty WHERE i = 1
  UNION ALL SELECT doc_id, i, seq + apart::INT, CASE WHEN apart THEN kind ELSE chunk_type END, CASE WHEN apart THEN entity ELSE entity_id END, CASE WHEN apart THEN size ELSE n_chars + 1 + size END, CASE WHEN apart THEN 1 ELSE n_blocks + 1 END
  FROM (SELECT t.doc_id, t.i, t.kind, t.entity, length(t.content) AS size, ck.seq, ck.chunk_type, ck.entity_id, ck.n_chars, ck.n_blocks,
    t.heading OR t.entity IS NOT NULL OR (t.kind <> ck.chunk_type AND ck.entity_id IS NULL) OR starts_with(t.kind, 'numbered') OR ck.n_chars + length(t.content) > 1000 AS apart FROM ck JOIN ty t ON t.doc_id = ck.doc_id AND t.i = ck.i + 1))
SELECT doc_id, seq, chunk_type, entity_id, CAST(max(n_chars) AS INT) AS n_chars, CAST(max(n_blocks) AS INT) AS n_blocks FROM ck GROUP BY doc_id, seq, chunk_type, entity_id""")
def c3(t):
    df = c.chunk_text(t.blocks)
    return df.select("doc_id", "seq", "chunk_type", "entity_id", F.length("content").alias("n_chars"), F.size("block_ids").alias("n_blocks"))


@query("c4_stable_chunk_id", ["chunks"], "SELECT chunk_id, concat_ws('_', chunk_type, entity_id, substr(sha256(content), 1, 8)) AS stable_id FROM chunks")
def c4(t):
    return t.chunks.select("chunk_id", c.stable_chunk_id(F.col("chunk_type"), F.col("entity_id"), F.col("content")).alias("stable_id"))


@query("c5_attach_notes", ["blocks"], r"""
, nt AS (SELECT doc_id, page_num, block_id AS note_id, block_content AS note_text, regexp_extract(block_content, '^\s*\$\s*\^\{?(\d+)\}?\s*\$', 1) AS note FROM blocks WHERE block_label = 'footnote'),
bd AS (SELECT *, list_distinct(regexp_extract_all(block_content, '\$\s*\^\{?(\d+)\}?\s*\$', 1)) AS cited FROM blocks WHERE block_label <> 'footnote'),
ex AS (SELECT b.doc_id, b.block_id, string_agg(note_text, chr(10) ORDER BY note_id) AS extra FROM (SELECT doc_id, page_num, block_id, unnest(cited) AS note FROM bd) b JOIN nt ON nt.doc_id = b.doc_id AND nt.page_num = b.page_num AND nt.note = b.note GROUP BY b.doc_id, b.block_id)
SELECT bd.doc_id, bd.block_id, md5(concat_ws(chr(10), block_content, extra)) AS content_md5 FROM bd LEFT JOIN ex ON ex.doc_id = bd.doc_id AND ex.block_id = bd.block_id""")
def c5(t):
    return c.attach_notes(t.blocks).select("doc_id", "block_id", F.md5("block_content").alias("content_md5"))


INSIDE = "block_bbox[1] >= bbox[1] - {s} AND block_bbox[2] >= bbox[2] - {s} AND block_bbox[3] <= bbox[3] + {s} AND block_bbox[4] <= bbox[4] + {s}"


@query("c6_assign_to_region", ["blocks", "regions"], ", hit AS (SELECT b.doc_id, b.block_id, arg_min(region_id, ((bbox[3] - bbox[1]) * (bbox[4] - bbox[2]), region_id)) AS region_id FROM blocks b JOIN regions r ON r.doc_id = b.doc_id AND r.page_num = b.page_num WHERE " + INSIDE.format(s=5) + " GROUP BY b.doc_id, b.block_id) SELECT b.doc_id, b.block_id, region_id FROM blocks b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.block_id = b.block_id")
def c6(t):
    return c.assign_to_region(t.blocks, t.regions).select("doc_id", "block_id", "region_id")


@query("c7_match_formula_numbers", ["blocks"], """
, fo AS (SELECT doc_id, page_num, block_id, block_bbox[2] AS top, block_bbox[3] AS rgt, block_bbox[4] AS bottom FROM blocks WHERE block_label = 'formula'),
nu AS (SELECT doc_id, page_num, trim(trim(block_content), '()') AS entity_id, block_bbox[1] AS lft, block_bbox[2] AS top, block_bbox[4] AS bottom, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY block_bbox[2], block_bbox[1], block_id) AS i FROM blocks WHERE block_label = 'formula_number'),
pr AS (SELECT n.doc_id, n.page_num, n.i, n.entity_id, f.block_id, abs((f.top + f.bottom) / 2 - (n.top + n.bottom) / 2) AS far, f.top < n.bottom AND f.bottom > n.top AND f.rgt <= n.lft + 1 AS level FROM nu n JOIN fo f ON f.doc_id = n.doc_id AND f.page_num = n.page_num),
op AS (SELECT * FROM pr WHERE level OR far <= 100),
-- numbers of a page claim in order; what was claimed is carried along
rc AS (SELECT DISTINCT doc_id, page_num, 0 AS i, CAST([] AS INT[]) AS taken FROM nu
  UNION ALL SELECT rc.doc_id, rc.page_num, rc.i + 1, CASE WHEN b.block_id IS NULL THEN taken ELSE list_append(taken, CAST(b.block_id AS INT)) END
  FROM rc JOIN nu ON nu.doc_id = rc.doc_id AND nu.page_num = rc.page_num AND nu.i = rc.i + 1
  LEFT JOIN LATERAL (SELECT arg_min(block_id, (NOT level, far, block_id)) AS block_id FROM op WHERE op.doc_id = rc.doc_id AND op.page_num = rc.page_num AND op.i = rc.i + 1 AND NOT list_contains(rc.taken, CAST(op.block_id AS INT))) b ON true)
SELECT nu.doc_id, nu.page_num, nu.entity_id, rc.taken[-1] AS block_id FROM rc JOIN nu ON nu.doc_id = rc.doc_id AND nu.page_num = rc.page_num AND nu.i = rc.i
  JOIN rc AS bf ON bf.doc_id = rc.doc_id AND bf.page_num = rc.page_num AND bf.i = rc.i - 1 WHERE len(rc.taken) > len(bf.taken)""")
def c7(t):
    return c.match_formula_numbers(t.blocks, reach=100.0).select("doc_id", "page_num", "entity_id", "block_id")


@query("c8_match_table_captions", ["blocks"], """
SELECT a.doc_id, a.block_id AS caption_id, arg_min(b.block_id, (round(sqrt(pow((a.block_bbox[1] + a.block_bbox[3]) / 2 - (b.block_bbox[1] + b.block_bbox[3]) / 2, 2) + pow((a.block_bbox[2] + a.block_bbox[4]) / 2 - (b.block_bbox[2] + b.block_bbox[4]) / 2, 2)), 6), b.block_id)) AS table_id
FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page_num = b.page_num WHERE a.block_label = 'table_caption' AND b.block_label = 'table' GROUP BY a.doc_id, a.block_id""")
def c8(t):
    return c.match_table_captions(t.blocks).select("doc_id", "caption_id", "table_id")


# what ends in > is (the rest of) a tag; names that stay are marked, as this engine cannot look ahead
@query("c9_clean_html", [], r"""
, rn AS (SELECT page_id, regexp_extract_all(html, '(?s)[^<>]*[<>]|[^<>]+') AS runs FROM pages),
cl AS (SELECT page_id, array_to_string(list_transform(runs, lambda x: CASE WHEN ends_with(x, '>') THEN replace(regexp_replace(regexp_replace(x, '(?i)(\s)((?:colspan|rowspan|href)\s*=)', '\1' || chr(2) || '\2', 'g'),
  '(?i)\s+[a-z_:][-\w:.]*(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?', '', 'g'), chr(2), '') ELSE x END), '') AS body FROM rn)
SELECT page_id, md5(body) AS clean_md5, length(body) AS n_clean FROM cl""")
def c9(t):
    return t.pages.select("page_id", F.md5(c.clean_html(F.col("html"))).alias("clean_md5"), F.length(c.clean_html(F.col("html"))).alias("n_clean"))


@query("c9_html_text", [], r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis'), '<head\b.*?</head\s*>', '', 'gis'), '<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ') AS body FROM pages""")
def c9t(t):
    return t.pages.select("page_id", c.html_text(F.col("html")).alias("body"))


def translations(t):
    return t.documents.where("doc_id % 10 = 1").select(F.expr("CASE doc_id % 6 WHEN 1 THEN 'algorithm' WHEN 2 THEN 'example' WHEN 3 THEN 'numbered_formula' WHEN 4 THEN 'exercise' ELSE 'numbered_table' END").alias("chunk_type"), F.expr("concat(1 + doc_id % 9, '.', 1 + doc_id % 37)").alias("entity_id"), F.concat(F.lit("translated "), F.col("doc_id")).alias("content"), F.col("doc_id").alias("load_order"))


TRANSLATIONS = """, tr AS (SELECT CASE doc_id % 6 WHEN 1 THEN 'algorithm' WHEN 2 THEN 'example' WHEN 3 THEN 'numbered_formula' WHEN 4 THEN 'exercise' ELSE 'numbered_table' END AS chunk_type, concat(1 + doc_id % 9, '.', 1 + doc_id % 37) AS entity_id, concat('translated ', doc_id) AS content, doc_id AS load_order FROM documents WHERE doc_id % 10 = 1)"""


@query("c10_merge_translations", ["chunks"], TRANSLATIONS + ", la AS (SELECT chunk_type, entity_id, arg_max(content, load_order) AS content FROM tr GROUP BY chunk_type, entity_id) SELECT chunk_id, md5(coalesce(la.content, c.content)) AS content_md5, la.content IS NOT NULL AS is_translated FROM chunks c LEFT JOIN la ON la.chunk_type = c.chunk_type AND la.entity_id = c.entity_id")
def c10(t):
    return c.merge_translations(t.chunks, translations(t)).select("chunk_id", F.md5("content").alias("content_md5"), "is_translated")


@query("c10_unmatched_translations", ["chunks"], TRANSLATIONS + " SELECT chunk_type, entity_id, load_order FROM tr WHERE (chunk_type, entity_id) NOT IN (SELECT chunk_type, entity_id FROM chunks WHERE entity_id IS NOT NULL)")
def c10u(t):
    return c.unmatched_translations(t.chunks, translations(t)).select("chunk_type", "entity_id", "load_order")


@query("c11_tag_normalize", [], r"""
, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, unnest(range(len(string_split(text, ' ')))) AS i FROM documents),
n AS (SELECT doc_id, i, regexp_replace(regexp_replace(upper(replace(trim(x), 'ß', 'ss')), '[ -]', '_', 'g'), '[^A-Z0-9_]', '', 'g') AS tag FROM w),
f AS (SELECT doc_id, tag, min(i) AS i FROM n WHERE regexp_matches(tag, '^[A-Z][A-Z0-9_]{2,}$') GROUP BY doc_id, tag)
SELECT d.doc_id, md5(coalesce(string_agg(tag, ',' ORDER BY i), '')) AS tags_md5, count(tag) AS n_tags FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def c11(t):
    tags = F.coalesce(c.tag_normalize(F.split("text", " ")), F.array().cast("array<string>"))
    return t.documents.select("doc_id", F.md5(F.array_join(tags, ",")).alias("tags_md5"), F.size(tags).cast("long").alias("n_tags"))


@query("c12_tag_merge", ["chunks"], """
SELECT chunk_id, CASE WHEN load_order % 2 = 0 THEN array_to_string(list_filter(list_distinct_ordered, lambda x: x IN ('TAG_0', 'TAG_1', 'TAG_2', 'TAG_3')), ',') ELSE '' END AS bc_concepts, CASE WHEN load_order % 3 = 0 AND load_order % 3 = 0 THEN 'TABLE_0' ELSE '' END AS bc_db_tables
FROM (SELECT *, CASE WHEN bc_concepts[1] = bc_concepts[2] THEN [bc_concepts[1]] ELSE bc_concepts END AS list_distinct_ordered FROM chunks)""")
def c12(t):
    concepts = t.chunks.where("load_order % 2 = 0").select("chunk_id", F.col("bc_concepts").alias("tags"))
    tables = t.chunks.where("load_order % 3 = 0").select("chunk_id", F.col("bc_db_tables").alias("tags"))
    df = c.tag_merge(t.chunks, concepts, tables, ["TAG_0", "TAG_1", "TAG_2", "TAG_3"], ["TABLE_0", "TABLE_1"])
    return df.select("chunk_id", joined("bc_concepts"), joined("bc_db_tables"))


@query("c13_pending_work", ["chunks"], """
, lg AS (SELECT concat('C', doc_id) AS chunk_id, 1 AS seq, CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS status FROM labels UNION ALL SELECT concat('C', doc_id), 2, 'failed' FROM labels WHERE toxic = 1),
la AS (SELECT chunk_id, arg_max(status, seq) AS status FROM lg GROUP BY chunk_id)
SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM la WHERE status = 'done')""")
def c13(t):
    key = F.concat(F.lit("C"), F.col("doc_id")).alias("chunk_id")
    log = t.labels.select(key, F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status")).union(t.labels.where("toxic = 1").select(key, F.lit(2), F.lit("failed")))
    return c.pending_work(t.chunks, log).select("chunk_id")


@query("c14_token_batches", ["chunks"], """
, nn AS (SELECT CAST(greatest(1, ceil(count(*) / 20000.0)) AS BIGINT) AS shards FROM chunks),
it AS (SELECT chunk_id, md5(concat(chunk_id, '42')) AS k, CAST(length(content) // 4 + 50 AS BIGINT) AS tokens FROM chunks),
sh AS (SELECT *, (CAST(concat('0x', substr(k, 1, 8)) AS BIGINT) * shards) >> 32 AS shard FROM it, nn),
od AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY k, chunk_id) AS i FROM sh),
ba AS (SELECT shard, i, chunk_id, tokens, 0 AS batch, tokens AS used FROM od WHERE i = 1
  UNION ALL SELECT o.shard, o.i, o.chunk_id, o.tokens, batch + CASE WHEN used + o.tokens > 4000 THEN 1 ELSE 0 END, CASE WHEN used + o.tokens > 4000 THEN o.tokens ELSE used + o.tokens END FROM ba JOIN od o ON o.shard = ba.shard AND o.i = ba.i + 1)
SELECT chunk_id, shard, batch, tokens FROM ba""")
def c14(t):
    return c.token_batches(t.chunks, 4000, 42)


FIGURES = """, fig AS (SELECT doc_id, page_num, block_id AS figure_id, CASE WHEN block_id % 2 = 0 THEN concat('F', page_num, '.', block_id % 4) END AS entity_id, concat('img', block_id % 6) AS link, block_bbox[2] + 10 AS y FROM blocks WHERE block_id % 5 = 0)"""


def figures(t):
    return t.blocks.where("block_id % 5 = 0").select("doc_id", "page_num", F.col("block_id").alias("figure_id"), F.expr("CASE WHEN block_id % 2 = 0 THEN concat('F', page_num, '.', block_id % 4) END").alias("entity_id"), F.expr("concat('img', block_id % 6)").alias("link"), (F.col("block_bbox")[1] + 10).alias("y"))


@query("c15_attach_figures", ["blocks"], FIGURES + """,
f1 AS (SELECT doc_id, entity_id, link, min(figure_id) AS i FROM fig WHERE entity_id IS NOT NULL GROUP BY doc_id, entity_id, link)
SELECT doc_id, entity_id, string_agg(link, ',' ORDER BY i) AS image_links FROM f1 GROUP BY doc_id, entity_id""")
def c15(t):
    return c.attach_figures(figures(t), t.blocks)[0].select("doc_id", "entity_id", joined("image_links"))


@query("c15_figure_blocks", ["blocks"], FIGURES + """ SELECT f.doc_id, figure_id, arg_max(b.block_id, (b.block_bbox[2], b.block_id)) AS block_id FROM fig f JOIN blocks b ON b.doc_id = f.doc_id AND b.page_num = f.page_num AND b.block_bbox[2] < f.y WHERE f.entity_id IS NULL GROUP BY f.doc_id, figure_id""")
def c15b(t):
    return c.attach_figures(figures(t), t.blocks)[1].select("doc_id", "figure_id", "block_id")


@query("c16_region_text", ["blocks", "regions"], """
, hit AS (SELECT b.*, region_id, block_content ~ '(?i)^\\s*(algorithm|example|figure|table)\\s+[A-Z]?\\d+\\.\\d+.*' AS cap FROM blocks b JOIN regions r ON r.doc_id = b.doc_id AND r.page_num = b.page_num
  WHERE block_bbox[1] / 600 >= bbox[1] / 600 - 0.05 AND block_bbox[2] / 800 >= bbox[2] / 800 - 0.05 AND block_bbox[3] / 600 <= bbox[3] / 600 + 0.05 AND block_bbox[4] / 800 <= bbox[4] / 800 + 0.05)
SELECT doc_id, page_num, region_id, count(*) AS n_blocks, md5(coalesce(string_agg(block_content, chr(10) ORDER BY block_bbox[2], block_bbox[1], block_id) FILTER (WHERE NOT cap), '')) AS content_md5,
  md5(coalesce(string_agg(block_content, chr(10) ORDER BY block_bbox[2], block_bbox[1], block_id) FILTER (WHERE cap), '')) AS caption_md5 FROM hit GROUP BY doc_id, page_num, region_id""")
def c16(t):
    unit = F.transform("bbox", lambda v, i: v / F.when(i % 2 == 0, 600.0).otherwise(800.0))
    blocks = t.blocks.withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    df = c.region_text(t.regions.withColumn("bbox", unit), blocks)
    return df.select("doc_id", "page_num", "region_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.md5("content").alias("content_md5"), F.md5("caption").alias("caption_md5"))


@query("c17_repair_note_splits", ["blocks"], r"""
, nt AS (SELECT f.doc_id, f.page_num, f.block_id, f.block_content AS note FROM blocks f JOIN blocks h ON h.doc_id = f.doc_id AND h.page_num = f.page_num AND h.block_id = f.block_id - 1 WHERE f.block_label = 'footnote' AND h.block_label <> 'footnote')
SELECT b.doc_id, b.block_id, md5(CASE WHEN b.block_label = 'footnote' THEN coalesce(regexp_replace(own.note, '^\s+|\s+$', '', 'g'), '') WHEN sw.note IS NOT NULL THEN regexp_replace(b.block_content, '\s+$', '') ELSE b.block_content END) AS content_md5
FROM blocks b LEFT JOIN nt own ON own.doc_id = b.doc_id AND own.block_id = b.block_id LEFT JOIN nt sw ON sw.doc_id = b.doc_id AND sw.block_id = b.block_id + 1""")
def c17(t):
    # a note that was swallowed: its text follows the block before it
    notes = t.blocks.where("block_label = 'footnote'").select("doc_id", "page_num", (F.col("block_id") - 1).alias("block_id"), F.col("block_content").alias("note"))
    df = t.blocks.join(notes, ["doc_id", "page_num", "block_id"], "left")
    content = F.when(F.col("block_label") == "footnote", "").otherwise(F.concat_ws("\n", "block_content", "note"))
    return c.repair_note_splits(df.withColumn("block_content", content).drop("note")).select("doc_id", "block_id", F.md5("block_content").alias("content_md5"))


@query("c18_rescale_boxes", ["blocks"], "SELECT doc_id, block_id, round(block_bbox[1] * 0.5, 6) AS x0, round(block_bbox[2] * 0.25, 6) AS y0, round(block_bbox[3] * 0.5, 6) AS x1, round(block_bbox[4] * 0.25, 6) AS y1 FROM blocks")
def c18(t):
    df = c.rescale_boxes(t.blocks, 0.5, 0.25)
    return df.select("doc_id", "block_id", *[F.round(F.col("block_bbox")[k], 6).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


NS = uuid.NAMESPACE_DNS.hex


def uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{NS}') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1)"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, substr({h}, 18, 3), '-', substr({h}, 21, 12))"


NAME = "CASE WHEN coalesce(entity_id, '') <> '' THEN concat_ws(':', entity_id, chunk_type) ELSE concat_ws(':', chunk_type, content) END"


@query("g1_deterministic_uuid", ["chunks"], f"SELECT chunk_id, {uuid_sql(NAME)} AS uuid FROM chunks")
def g1(t):
    return g.deterministic_uuid(t.chunks).select("chunk_id", "uuid")


REFS = ", refs AS (" + " UNION ALL ".join(f"SELECT chunk_id AS src, '{f}' AS field, '{k}' AS chunk_type, unnest({f}) AS entity_id FROM chunks" for f, k in g.TARGETS.items()) + "), tgt AS (SELECT entity_id, chunk_type, arg_max(chunk_id, load_order) AS dst FROM chunks WHERE entity_id IS NOT NULL GROUP BY entity_id, chunk_type)"


@query("g2_reference_edges", ["chunks"], REFS + " SELECT src, field, dst FROM refs JOIN tgt USING (entity_id, chunk_type)")
def g2(t):
    return g.reference_edges(t.chunks)


@query("g3_dangling_references", ["chunks"], REFS + " SELECT src, field, refs.chunk_type, refs.entity_id FROM refs LEFT JOIN tgt ON tgt.entity_id = refs.entity_id AND tgt.chunk_type = refs.chunk_type WHERE dst IS NULL")
def g3(t):
    return g.dangling_references(t.chunks)


@query("g4_entity_gaps", ["chunks"], r"""
, pt AS (SELECT chunk_type, regexp_extract(entity_id, '^(.*)\.[^.]*$', 1) AS parent, regexp_extract(entity_id, '([^.]*)$', 1) AS tail FROM chunks WHERE entity_id IS NOT NULL),
ok AS (SELECT chunk_type, parent FROM pt GROUP BY chunk_type, parent HAVING bool_and(regexp_matches(tail, '^\d+$'))),
nm AS (SELECT DISTINCT chunk_type, parent, CAST(tail AS INT) AS n FROM pt JOIN ok USING (chunk_type, parent)),
al AS (SELECT chunk_type, parent, unnest(range(1, max(n))) AS missing FROM nm GROUP BY chunk_type, parent)
SELECT chunk_type, parent, CAST(missing AS INT) AS missing FROM al WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.chunk_type = al.chunk_type AND nm.parent = al.parent AND nm.n = al.missing)""")
def g4(t):
    return g.entity_gaps(t.chunks)


@query("g5_invalid_entity_ids", ["chunks"], r"""
SELECT chunk_id, chunk_type, entity_id, CASE WHEN entity_id IS NULL OR entity_id = '' THEN 'missing' ELSE 'malformed' END AS problem FROM chunks WHERE chunk_type <> 'text' AND (entity_id IS NULL OR entity_id = '' OR NOT regexp_matches(entity_id, '^[A-Z\d]+(\.\d+)+$'))""")
def g5(t):
    return g.invalid_entity_ids(t.chunks)


@query("g6_duplicate_entity_ids", ["chunks"], "SELECT chunk_type, entity_id, count(*) AS n FROM chunks WHERE entity_id IS NOT NULL GROUP BY chunk_type, entity_id HAVING count(*) > 1")
def g6(t):
    return g.duplicate_entity_ids(t.chunks)


@query("g7_hierarchy_issues", ["chunks"], """
SELECT chunk_id, issue FROM (SELECT chunk_id, unnest([CASE WHEN section_number <> '' AND coalesce(section_title, '') = '' THEN 'section_without_title' END, CASE WHEN subsection_number <> '' AND coalesce(subsection_title, '') = '' THEN 'subsection_without_title' END,
  CASE WHEN subsubsection_number <> '' AND coalesce(subsubsection_title, '') = '' THEN 'subsubsection_without_title' END, CASE WHEN subsection_number <> '' AND coalesce(section_number, '') = '' THEN 'subsection_without_section' END, CASE WHEN subsubsection_number <> '' AND coalesce(subsection_number, '') = '' THEN 'subsubsection_without_subsection' END]) AS issue FROM chunks) WHERE issue IS NOT NULL""")
def g7(t):
    return g.hierarchy_issues(t.chunks)


@query("g8_distinct_references", ["chunks"], REFS + """
, di AS (SELECT DISTINCT field, entity_id FROM refs)
SELECT field, entity_id, row_number() OVER (PARTITION BY field ORDER BY regexp_matches(split_part(entity_id, '.', 1), '^[0-9]+$') DESC, coalesce(TRY_CAST(split_part(entity_id, '.', 1) AS INT), 0), split_part(entity_id, '.', 1), coalesce(TRY_CAST(split_part(entity_id, '.', 2) AS INT), 0)) AS place FROM di""")
def g8(t):
    return g.distinct_references(t.chunks).select("field", "entity_id", F.col("place").cast("long").alias("place"))


@query("g9_parent_chunk_link", ["chunks"], f", kn AS (SELECT chunk_id AS parent, {uuid_sql(NAME)} AS parent_uuid FROM chunks) SELECT chunk_id, CASE WHEN parent_uuid IS NOT NULL THEN defined_in_chunk END AS defined_in_chunk, parent_uuid FROM chunks LEFT JOIN kn ON parent = defined_in_chunk")
def g9(t):
    return g.parent_chunk_link(t.chunks).select("chunk_id", "defined_in_chunk", "parent_uuid")


WORDS = r"filter(transform(split(coalesce(text, ''), '\n'), l -> regexp_extract_all(l, '[A-Za-z]+', 0)), w -> size(w) > 0)"
NAMES = "transform(w, (x, i) -> concat('f', doc_id, '_', i, '_', x[0]))"
DEFINITION = r"concat('def ', n, '(x):\n    return ', coalesce(get(names, i + 1), concat('K', doc_id + 3)), '(', array_join(concat(array('x'), transform(get(w, i), v -> concat('v_', v))), ', '), ')')"
METHOD = r"concat('    def m(self):\n        return self.m(', coalesce(get(names, 0), 'len'), '(1), K', doc_id + 1, '())')"


def spread(docs):
    """Documents dealt out by id: parsing is long work for few bytes, so the parts of a file are too coarse."""
    return docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def programs(docs):
    """Documents as programs: every line is a function that calls the next one with the words of the line;
    a class begins and the last line ends with classes of other documents. doc_id, names, defs, method."""
    df = docs.select("doc_id", F.expr(WORDS).alias("w")).withColumn("names", F.expr(NAMES))
    return df.select("doc_id", "names", F.expr(f"transform(names, (n, i) -> {DEFINITION})").alias("defs"), F.expr(METHOD).alias("method"))


def fragments(docs):
    """One program a document; one in eleven does not parse."""
    code = F.expr(r"concat('class K', doc_id, ':\n', method, '\n\n\n', array_join(defs, '\n\n\n'), '\n', CASE WHEN doc_id % 11 = 0 THEN 'def broken(:\n' ELSE '' END)")
    return programs(docs).select(F.concat(F.lit("F"), "doc_id").alias("fragment_id"), code.alias("code"), "doc_id")


def entities_of(t):
    return g.code_entities(fragments(spread(t.documents)))


PROGRAMS = """
, ws AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_extract_all(l, '[A-Za-z]+')), lambda x: len(x) > 0) AS w FROM documents),
nm AS (SELECT *, concat('F', doc_id) AS fragment_id, concat('K', doc_id) AS cls, list_transform(w, lambda x, i: concat('f', doc_id, '_', i - 1, '_', x[1])) AS names FROM ws),
nx AS (SELECT *, CASE WHEN len(names) > 0 THEN list_append(names[2:], concat('K', doc_id + 3)) ELSE [] END AS nexts FROM nm),
en AS (SELECT fragment_id, doc_id, 'class' AS kind, cls AS name, NULL AS detail FROM nx UNION ALL SELECT fragment_id, doc_id, 'method', cls || '.m', cls FROM nx
  UNION ALL SELECT fragment_id, doc_id, 'call', cls || '.m', unnest(['self.m', coalesce(names[1], 'len'), concat('K', doc_id + 1)]) FROM nx
  UNION ALL SELECT fragment_id, doc_id, 'function', unnest(names), NULL FROM nx UNION ALL SELECT fragment_id, doc_id, 'call', unnest(names), unnest(nexts) FROM nx),
ok AS (SELECT * FROM en WHERE doc_id % 11 <> 0),
df AS (SELECT DISTINCT kind, name, detail FROM ok WHERE kind <> 'call'),
cg AS (SELECT DISTINCT c.name AS caller, df.name AS callee, df.kind FROM ok c JOIN df ON df.name = CASE WHEN c.detail = 'self.m' THEN c.name ELSE c.detail END WHERE c.kind = 'call')"""


@query("g10_code_entities", [], PROGRAMS + " SELECT fragment_id, kind, name, detail FROM ok")
def g10(t):
    return entities_of(t)


@query("g11_call_graph", [], PROGRAMS + " SELECT caller, callee, kind FROM cg")
def g11(t):
    return g.call_graph(written(entities_of(t), "entities"))


LEVELS = PROGRAMS + """,
walk AS (SELECT callee AS name, 0 AS k FROM cg WHERE callee NOT IN (SELECT caller FROM cg WHERE caller <> callee) UNION SELECT caller, k + 1 FROM walk JOIN cg ON callee = name WHERE caller <> callee),
ln AS (SELECT caller AS name FROM cg UNION SELECT callee FROM cg),
ll AS (SELECT ln.name, ln.name AS component, coalesce(max(k), 0) AS level FROM ln LEFT JOIN walk USING (name) GROUP BY ln.name)"""


@query("g16_call_levels", [], LEVELS + " SELECT name, component, level FROM ll")
def g16_levels(t):
    return cgr.call_levels(written(g.call_graph(written(entities_of(t), "entities")), "calls"))


def schema_of(t):
    entities = written(entities_of(t), "entities")
    return g.code_schema(entities, g.call_graph(entities))


SCHEMA = PROGRAMS + f""",
sc AS (SELECT kind, name, detail AS class_ref, {uuid_sql("concat(kind, ':', name)")} AS id FROM df),
rf AS (SELECT caller AS name, {", ".join(f"string_agg(DISTINCT CASE WHEN kind = '{k}' THEN {uuid_sql("concat(kind, ':', callee)")} END, ',' ORDER BY CASE WHEN kind = '{k}' THEN {uuid_sql("concat(kind, ':', callee)")} END) AS {k}_refs" for k in ("class", "method", "function"))} FROM cg GROUP BY caller)"""


@query("g12_code_schema", [], SCHEMA + " SELECT kind, name, class_ref, id, coalesce(class_refs, '') AS referenced_classes, coalesce(method_refs, '') AS referenced_methods, coalesce(function_refs, '') AS referenced_functions FROM sc LEFT JOIN rf USING (name)")
def g12(t):
    return schema_of(t).select("kind", "name", "class_ref", "id", joined("referenced_classes"), joined("referenced_methods"), joined("referenced_functions"))


@query("g13_code_refs", [], SCHEMA + ", ud AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest([names[1], cls]) AS name FROM nx) SELECT DISTINCT chunk_id, kind, name, id FROM ud JOIN sc USING (name)")
def g13(t):
    # the prose of a document and a fence that uses what it defines
    fence = F.concat(F.lit("\n```python\ny = "), F.coalesce(F.get("names", F.lit(0)), F.lit("len")), F.lit("(K"), "doc_id", F.lit("())\n```\n"))
    prose = programs(t.documents).select("doc_id", fence.alias("fence")).join(t.documents.select("doc_id", "text"), "doc_id")
    return g.code_refs(prose.select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.coalesce("text", F.lit("")), "fence").alias("content")), schema_of(t))


USAGE = PROGRAMS + """,
us AS (SELECT DISTINCT d.cls AS name, d.fragment_id AS home, u.fragment_id AS used_in FROM nx d JOIN (SELECT fragment_id, unnest(CASE WHEN len(names) > 0 THEN [doc_id + 1, doc_id + 3] ELSE [doc_id + 1] END) AS doc_id FROM nx) u ON u.doc_id = d.doc_id)"""


def usage(t):
    frags = fragments(t.documents).withColumnRenamed("fragment_id", "block_id")
    return g.usage_index(frags, frags.select("block_id", F.concat(F.lit("K"), "doc_id").alias("name")))


@query("g14_usage_index", [], USAGE + " SELECT name, home, used_in FROM us")
def g14(t):
    return usage(t)


@query("g15_related_definitions", [], USAGE + " SELECT used_in AS block_id, name, home FROM us WHERE CAST(substr(home, 2) AS BIGINT) % 10 < CAST(substr(used_in, 2) AS BIGINT) % 10")
def g15(t):
    return g.related_definitions(usage(t), fragments(t.documents).select(F.col("fragment_id").alias("block_id"), (F.col("doc_id") % 10).alias("chapter")))


def closure(t, entities):
    roots = entities.where("kind = 'method'").select(F.col("name").alias("root"), "name")
    return g.code_closure(roots, g.call_graph(entities))


CLOSURE = PROGRAMS + """,
lv AS (SELECT DISTINCT name AS root, name, 0 AS depth FROM df WHERE kind = 'method' UNION SELECT root, callee, depth + 1 FROM lv JOIN cg ON cg.caller = lv.name WHERE depth < 5),
cl AS (SELECT root, name, max(depth) AS depth FROM lv GROUP BY root, name)"""


@query("g16_code_closure", [], CLOSURE + " SELECT root, name, depth FROM cl")
def g16(t):
    return closure(t, written(entities_of(t), "entities"))


@query("g16_callees_first", [], LEVELS + """,
rt AS (SELECT DISTINCT name AS root FROM df WHERE kind = 'method'),
held AS (SELECT DISTINCT name FROM df WHERE kind = 'class' AND length(name) % 2 = 0 AND concat(name, '.m') IN (SELECT root FROM rt)),
dv AS (SELECT root, root AS name, 0 AS depth FROM rt UNION SELECT root, callee, depth + 1 FROM dv JOIN cg ON cg.caller = dv.name WHERE depth < 5 AND callee NOT IN (SELECT name FROM held)),
dc AS (SELECT root, name, max(depth) AS depth FROM dv GROUP BY root, name)
SELECT root, dc.name, depth, coalesce(level, 0) AS level, row_number() OVER (PARTITION BY root ORDER BY coalesce(level, 0), dc.name) AS place FROM dc LEFT JOIN ll USING (name)""")
def g16_order(t):
    entities = written(entities_of(t), "entities")
    calls = written(g.call_graph(entities), "calls")
    roots = entities.where("kind = 'method'").select(F.col("name").alias("root"), "name")
    # classes with names of even length come with the algorithm that is their method
    algorithms = entities.where("kind = 'class' and length(name) % 2 = 0").select("name", F.concat("name", F.lit(".m")).alias("algorithm")).distinct()
    found = written(g.code_closure(roots, calls, algorithms=algorithms), "closure")
    return cgr.callees_first(found, cgr.call_levels(calls)).select("root", "name", "depth", "level", F.col("place").cast("long").alias("place"))


@query("g17_assemble_source", [], CLOSURE + """,
src AS (SELECT cls || '.m' AS name, cls AS block, concat('    def m(self):', chr(10), '        return self.m(', coalesce(names[1], 'len'), '(1), K', doc_id + 1, '())') AS code FROM nx
  UNION ALL SELECT cls, cls, concat('class ', cls, ':') FROM nx
  UNION ALL SELECT name, name, concat('def ', name, '(x):', chr(10), '    return ', nxt, '(', array_to_string(list_concat(['x'], list_transform(ww, lambda v: concat('v_', v))), ', '), ')') FROM (SELECT unnest(names) AS name, unnest(nexts) AS nxt, unnest(w) AS ww FROM nx)),
bl AS (SELECT root, block, max(depth) AS depth, string_agg(code, chr(10) ORDER BY src.name <> block, depth DESC, src.name) AS code FROM cl JOIN src USING (name) GROUP BY root, block)
SELECT root, md5(string_agg(code, chr(10) || chr(10) ORDER BY depth DESC, block)) AS source_md5, count(*) AS n_blocks FROM bl GROUP BY root""")
def g17(t):
    p = programs(t.documents)
    cls = F.concat(F.lit("K"), "doc_id")
    none = F.lit(None).cast("string")
    functions = p.select(F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("defs").alias("code"))).alias("d")).select("d.name", none.alias("class_ref"), "d.code")
    methods = p.select(F.concat(cls, F.lit(".m")).alias("name"), cls.alias("class_ref"), F.col("method").alias("code"))
    classes = p.select(cls.alias("name"), none.alias("class_ref"), F.concat(F.lit("class "), cls, F.lit(":")).alias("code"))
    found = closure(t, written(entities_of(t), "entities"))
    return g.assemble_source(found, functions.union(methods).union(classes)).select("root", F.md5("source").alias("source_md5"), "n_blocks")


def sims(k: int, where: str = "true") -> str:
    return f"""
, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {where}), qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv.e, v.e), 9) AS similarity FROM qv, v),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= {k})"""


def query_vectors(t):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("r1_vector_topk", [], sims(10) + " SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM hits")
def r1(t):
    return r.vector_topk(t.embeddings.select("vec_id", "embedding"), query_vectors(t), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6("similarity"))


@query("r2_metadata_filter", ["chunks"], "SELECT chunk_id FROM chunks WHERE part = 'en' OR chunk_type IN ('algorithm', 'example') OR list_has_any(bc_concepts, ['TAG_3', 'TAG_6'])")
def r2(t):
    cond = [("part", "EQ", "en"), ("chunk_type", "IN", ["algorithm", "example"]), ("bc_concepts", "IN", ["TAG_3", "TAG_6"])]
    return t.chunks.where(r.metadata_filter(t.chunks, cond, any_of=True)).select("chunk_id")


@query("r3_scope_filters", ["chunks"], "SELECT chunk_id FROM chunks WHERE part = 'en' AND section_number = 'src3'")
def r3(t):
    return t.chunks.where(r.metadata_filter(t.chunks, r.scope_filters(part="en", section="src3"))).select("chunk_id")


FIRST_CHUNKS = "fc AS (SELECT CAST(doc_id AS BIGINT) AS vec_id, concat('C', doc_id) AS chunk_id, [concat('TAG_', doc_id % 7), concat('TAG_', doc_id % 5)] AS bc_concepts, [concat('TABLE_', doc_id % 3)] AS bc_db_tables FROM documents)"
BOOST = """
bs AS (SELECT query_id, rank, vec_id, chunk_id, round(least(1, similarity + 0.1 * (CASE WHEN list_contains(bc_concepts, 'TAG_3') THEN 1 ELSE 0 END + CASE WHEN list_contains(bc_concepts, 'TAG_1') THEN 1 ELSE 0 END + CASE WHEN list_contains(bc_db_tables, 'TABLE_1') THEN 1 ELSE 0 END)), 9) AS score FROM hits JOIN fc USING (vec_id)),
bo AS (SELECT * FROM (SELECT query_id, vec_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM bs) WHERE rank <= 10)"""


def one_chunk_a_vector(t):
    return t.chunks.withColumn("vec_id", F.col("load_order"))


def boosted(t):
    hits = r.vector_topk(t.embeddings.select("vec_id", "embedding"), query_vectors(t), 20).join(one_chunk_a_vector(t).select("vec_id", "chunk_id", "bc_concepts", "bc_db_tables"), "vec_id")
    return r.tag_boost(hits, ["TAG_3", "TAG_1"], ["TABLE_1"], 10)


@query("r4_tag_boost", ["chunks"], sims(20) + ", " + FIRST_CHUNKS + ", " + BOOST + " SELECT query_id, chunk_id, rank, round(score, 6) AS similarity FROM bo")
def r4(t):
    return boosted(t).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), r6("similarity"))


@query("r5_expand_graph", ["chunks"], sims(20) + ", " + FIRST_CHUNKS + ", " + BOOST + REFS + " SELECT query_id, bo.chunk_id AS root_id, field, dst AS chunk_id FROM bo JOIN refs ON src = bo.chunk_id JOIN tgt USING (entity_id, chunk_type) WHERE field IN ('referenced_algorithms', 'referenced_examples')")
def r5(t):
    return r.expand_graph(boosted(t), g.reference_edges(t.chunks), ["referenced_algorithms", "referenced_examples"])


@query("r6_search_knowledge", ["chunks"], sims(20, "vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')") + ", " + FIRST_CHUNKS + ", " + BOOST + REFS + """,
ro AS (SELECT query_id, chunk_id, rank AS p1, 0 AS p2, '' AS p3, score FROM bo UNION ALL SELECT query_id, dst, 1000 + rank, 1, field, NULL FROM bo JOIN refs ON src = bo.chunk_id JOIN tgt USING (entity_id, chunk_type))
SELECT query_id, chunk_id, place, score AS similarity FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p2, p1, p3) AS rn, CASE WHEN p2 = 0 THEN 'hit' ELSE 'linked' END AS place FROM ro) WHERE rn = 1""")
def r6q(t):
    df = r.search_knowledge(one_chunk_a_vector(t), t.embeddings.select("vec_id", "embedding"), query_vectors(t), g.reference_edges(t.chunks), 10, ["TAG_3", "TAG_1"], ["TABLE_1"], r.scope_filters(part="en"))
    return df.select("query_id", "chunk_id", F.when(F.col("position") < 10**12, "hit").otherwise("linked").alias("place"), r6("similarity"))


@query("r7_entity_by_number", ["chunks"], "SELECT chunk_type, entity_id, arg_min(chunk_id, load_order) AS chunk_id FROM chunks WHERE (chunk_type, entity_id) IN (SELECT 'algorithm', unnest(referenced_algorithms) FROM chunks WHERE part = 'de') GROUP BY chunk_type, entity_id")
def r7(t):
    wanted = t.chunks.where("part = 'de'").select(F.lit("algorithm").alias("chunk_type"), F.explode("referenced_algorithms").alias("entity_id"))
    return r.entity_by_number(t.chunks, wanted)


@query("r8_get_by_ids", ["chunks"], "SELECT chunk_id, chunk_type, page FROM chunks WHERE chunk_id IN (SELECT concat('C', doc_id) FROM labels WHERE toxic = 1)")
def r8(t):
    return r.get_by_ids(t.chunks, t.labels.where("toxic = 1").select(F.concat(F.lit("C"), F.col("doc_id")))).select("chunk_id", "chunk_type", "page")


@query("r9_tag_catalog", ["chunks"], "SELECT DISTINCT 'concept' AS category, unnest(bc_concepts) AS tag FROM chunks UNION SELECT DISTINCT 'table', unnest(bc_db_tables) FROM chunks")
def r9(t):
    catalog = t.chunks.select(F.create_map(F.lit("concept"), F.col("bc_concepts"), F.lit("table"), F.col("bc_db_tables")).alias("tags"))
    return r.tag_catalog(catalog)

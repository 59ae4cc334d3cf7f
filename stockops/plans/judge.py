"""Queries of evaluation and of the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.durable import shared_folder
from ..operators import evaluation as e
from ..operators import retrieval as r
from ..streaming import twins
from .registry import joined, query, r6, us
from .text import query_vectors, sims

# what a query vector should find are the vectors of its own label, all of them
METRICS = sims(10) + """,
sz AS (SELECT q.vec_id AS query_id, count(*) AS n_expected FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id),
ht AS (SELECT h.query_id, count(*) AS n_hit, min(rank) AS best FROM hits h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings v ON v.vec_id = h.vec_id AND v.label = q.label GROUP BY h.query_id),
me AS (SELECT sz.query_id, sz.query_id % 3 AS case_id, n_expected, coalesce(n_hit, 0) AS n_hit, coalesce(n_hit, 0) / CAST(n_expected AS DOUBLE) AS recall, coalesce(n_hit, 0) / 10.0 AS precision, coalesce(1.0 / best, 0) AS mrr FROM sz LEFT JOIN ht USING (query_id))"""


def metrics(t):
    results = r.vector_topk(t.embeddings.select("vec_id", "embedding"), query_vectors(t), 10).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return e.class_metrics(results, q, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label"), 10).withColumn("case_id", F.col("query_id") % 3)


@query("e1_retrieval_metrics", [], METRICS + " SELECT query_id, n_expected, n_hit, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr FROM me")
def e1(t):
    return metrics(t).select("query_id", "n_expected", F.col("n_hit").cast("long").alias("n_hit"), r6("recall"), r6("precision"), r6("mrr"))


@query("e2_retrieval_summary", [], METRICS + " SELECT case_id, count(*) AS n_queries, round(avg(recall), 6) AS avg_recall, round(min(recall), 6) AS min_recall, round(max(recall), 6) AS max_recall, round(avg(precision), 6) AS avg_precision, round(avg(mrr), 6) AS avg_mrr, round(avg(CASE WHEN recall >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, bool_and(recall >= 0.8) AS all_passed FROM me GROUP BY ROLLUP (case_id)")
def e2(t):
    df = e.retrieval_summary(metrics(t))
    return df.select("case_id", "n_queries", *[r6(c) for c in ("avg_recall", "min_recall", "max_recall", "avg_precision", "avg_mrr", "pass_rate")], "all_passed")


@query("e3_stratified_sample", ["chunks"], "SELECT chunk_id, chunk_type FROM (SELECT *, row_number() OVER (PARTITION BY chunk_type ORDER BY md5(concat(chunk_id, '42')), chunk_id) AS rn FROM chunks) WHERE rn <= 10")
def e3(t):
    return e.stratified_sample(t.chunks, 5, 42).select("chunk_id", "chunk_type")


@query("e4_assign_split", ["golden"], "SELECT id, CASE WHEN md5(concat(id, '42')) < 'cccccccc' THEN 'validation' ELSE 'test' END AS split FROM golden")
def e4(t):
    return e.assign_split(t.golden, 42).select("id", "split")


def questions(t):
    """Questions made of document words, some in the wording that rules reject."""
    d = t.documents
    text = F.expr(
        "CASE doc_id % 7 WHEN 0 THEN concat('How is it expressed as ', text) WHEN 1 THEN concat('What does Exercise ', doc_id % 9, '.', doc_id % 5, ' ask?') WHEN 2 THEN concat('Which rule in the example uses ', text) WHEN 3 THEN 'What is Plan(s) for' WHEN 4 THEN 'What is the .QTY field' WHEN 5 THEN 'alpha_{t} value' ELSE concat('What is ', text) END"
    )
    q = d.select(F.concat(F.lit("Q"), "doc_id").alias("id"), text.alias("question"))
    exp = d.select(F.concat(F.lit("Q"), "doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("C"), "doc_id"), F.concat(F.lit("C"), F.col("doc_id") + 3))).alias("chunk_id"))
    return q, exp


@query("e5_validate_questions", ["chunks"], r"""
, q AS (SELECT concat('Q', doc_id) AS id, CASE doc_id % 7 WHEN 0 THEN concat('How is it expressed as ', text) WHEN 1 THEN concat('What does Exercise ', doc_id % 9, '.', doc_id % 5, ' ask?') WHEN 2 THEN concat('Which rule in the example uses ', text) WHEN 3 THEN 'What is Plan(s) for' WHEN 4 THEN 'What is the .QTY field' WHEN 5 THEN 'alpha_{t} value' ELSE concat('What is ', text) END AS question FROM documents),
ex AS (SELECT concat('Q', doc_id) AS id, unnest([concat('C', doc_id), concat('C', doc_id + 3)]) AS chunk_id FROM documents),
pr AS (SELECT ex.id, count(*) FILTER (chunk_type IN ('exercise', 'example')) AS n_ex, count(*) FILTER (chunk_type = 'algorithm') AS n_alg, count(*) FILTER (chunk_type = 'numbered_formula') AS n_formula, string_agg(coalesce(content, ''), ' ' ORDER BY ex.chunk_id) AS body FROM ex LEFT JOIN chunks c ON c.chunk_id = ex.chunk_id GROUP BY ex.id),
nm AS (SELECT *, list_concat(regexp_extract_all(body, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)', 1), list_filter(regexp_extract_all(body, '\b([a-z_]+_[a-z_]+)\s*\(', 1), lambda n: length(n) > 5)) AS names FROM q JOIN pr USING (id)),
rs AS (SELECT id, CASE WHEN n_ex >= 2 THEN 'two_exercises' WHEN n_alg >= 2 THEN 'two_algorithms'
 WHEN n_ex > 0 AND NOT regexp_matches(question, '(?i)\b(Exercise|Example)\s+\d+\.\d+') AND NOT regexp_matches(question, '(?i)\bin\s+the\s+(example|exercise)') THEN 'exercise_not_referenced'
 WHEN n_alg > 0 AND len(list_filter(names, lambda n: contains(lower(question), lower(n)))) = 0 THEN 'no_algorithm_name'
 WHEN n_formula = 0 AND (regexp_matches(question, '(?i)\b(expressed|written|formulated|represented)\s+(as|in|recursively)\b|\bhow\s+(is|are|do)\s+.*\s+(expressed|written|formulated|represented)\b') OR regexp_matches(question, '[\\^_{}]|[αβγδεπθλμσΣ∑∏]')) THEN 'formula_focused'
 WHEN len(list_filter(regexp_extract_all(question, '(?i)(?:Exercise|Example)\s+(\d+\.\d+)', 1), lambda x: NOT contains(lower(body), lower(x)))) > 0 THEN 'number_not_in_chunk'
 WHEN len(list_filter(regexp_extract_all(question, '\b([A-Z][A-Za-z_]*)\([^)]*\)', 1), lambda x: NOT contains(lower(body), lower(x)))) > 0 THEN 'term_not_in_chunk'
 WHEN len(list_filter(regexp_extract_all(question, '\.([A-Z_]+)\s+field', 1), lambda x: NOT contains(lower(body), lower(x)))) > 0 THEN 'field_not_in_chunk' ELSE 'OK' END AS reason FROM nm)
SELECT id, reason = 'OK' AS is_valid, reason FROM rs""")
def e5(t):
    q, exp = questions(t)
    return e.validate_questions(q, exp, t.chunks)


ANSWERS = """SELECT concat('A', conv_id, '-', turn) AS scenario_id, role AS category, CASE turn % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN conv_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS status,
 text AS algorithm, CASE WHEN conv_id % 4 = 0 THEN '^(the|la|die|el).*' END AS want_algorithm, conv_id % 3 = 0 AS want_formula, conv_id % 5 = 0 AS want_code, CASE WHEN conv_id % 2 = 0 THEN {sections} END AS want_sections,
 CAST(1 AS INT) AS min_recs, CAST(CASE WHEN conv_id % 7 = 0 THEN 1 END AS INT) AS max_recs, CAST(turn % 2 AS INT) AS n_formulas, CAST(conv_id % 3 AS INT) AS n_citations, {own} AS sections, CAST(turn % 3 AS INT) AS n_snippets, CAST(greatest(0, turn % 3 - conv_id % 2) AS INT) AS n_valid_snippets,
 CAST(conv_id % 8 AS INT) AS trace_len, text AS analysis, {recs} AS recommendations FROM {conversations}"""


def answers(t):
    sql = ANSWERS.replace("{sections}", "array('3', '7')").replace("{own}", "array(CAST(conv_id % 10 AS STRING))").replace("{recs}", "filter(array(text, CASE WHEN conv_id % 3 = 0 THEN replace(text, 'e', '') END), x -> x IS NOT NULL AND conv_id % 11 <> 0)")
    return t.spark.sql(sql, conversations=t.conversations)


ANSWERS_SQL = ", an AS (" + ANSWERS.replace("{sections}", "['3', '7']").replace("{own}", "[CAST(conv_id % 10 AS VARCHAR)]").replace("{recs}", "CASE WHEN conv_id % 11 = 0 THEN [] ELSE list_filter([text, CASE WHEN conv_id % 3 = 0 THEN replace(text, 'e', '') END], lambda x: x IS NOT NULL) END").replace("{conversations}", "conversations") + ")"
SCORES = ANSWERS_SQL + """,
fl AS (SELECT *, want_algorithm IS NOT NULL AND NOT regexp_matches(lower(algorithm), lower(want_algorithm)) AS b1, want_formula AND n_formulas = 0 AS b2, want_code AND n_snippets = 0 AS b3, want_sections IS NOT NULL AND n_citations = 0 AS c0, want_sections IS NOT NULL AND n_citations > 0 AND NOT list_has_any(sections, want_sections) AS c1,
 n_valid_snippets < n_snippets AS s1, trace_len = 0 AS t1, length(analysis) BETWEEN 1 AND 49 AS t2, len(recommendations) = 0 AS r0, coalesce(len(recommendations) > max_recs, false) AS r2, len(list_filter(recommendations, lambda x: length(x) < 10)) > 0 AS r3 FROM an),
sc AS (SELECT *, greatest(0, 1 - b1::INT * 0.5 - b2::INT * 0.3 - b3::INT * 0.2) AS retrieval_accuracy, CASE WHEN c0 THEN 0 ELSE 1 - c1::INT * 0.5 END AS citation_quality, CASE WHEN n_snippets = 0 THEN 1 ELSE n_valid_snippets / CAST(n_snippets AS DOUBLE) END AS code_validity,
 1 - t1::INT * 0.5 - t2::INT * 0.3 AS reasoning_quality, CASE WHEN r0 THEN 0 ELSE 1 - r2::INT * 0.3 - r3::INT * 0.2 END AS actionability,
 concat_ws(',', CASE WHEN b1 THEN 'algorithm' END, CASE WHEN b2 THEN 'formulas' END, CASE WHEN b3 THEN 'code' END, CASE WHEN c0 THEN 'no_citations' END, CASE WHEN c1 THEN 'sections' END, CASE WHEN s1 THEN 'invalid_code' END, CASE WHEN t1 THEN 'no_trace' END, CASE WHEN t2 THEN 'short_analysis' END, CASE WHEN r0 THEN 'no_recommendations' END, CASE WHEN r2 THEN 'many_recommendations' END, CASE WHEN r3 THEN 'vague_recommendation' END) AS reasons FROM fl),
sr AS (SELECT *, round(retrieval_accuracy * 0.3 + citation_quality * 0.2 + code_validity * 0.15 + reasoning_quality * 0.15 + actionability * 0.2, 9) AS overall_score FROM sc),
ps AS (SELECT *, overall_score >= 0.7 AND status = 'completed' AND reasons = '' AS passed FROM sr)"""


@query("e6_agent_scores", [], SCORES + " SELECT scenario_id, round(overall_score, 6) AS overall_score, reasons AS failure_reasons, passed FROM ps")
def e6(t):
    return e.agent_scores(answers(t)).select("scenario_id", r6("overall_score"), joined("failure_reasons"), "passed")


@query("e7_agent_report", [], SCORES + """ SELECT CASE WHEN category IS NOT NULL THEN 'category' WHEN difficulty IS NOT NULL THEN 'difficulty' ELSE 'all' END AS scope, coalesce(category, difficulty, '') AS name, count(*) AS total, CAST(count(*) FILTER (passed) AS BIGINT) AS n_passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(overall_score), 6) AS avg_score, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS n_failed
FROM ps GROUP BY GROUPING SETS ((category), (difficulty), ())""")
def e7(t):
    df = e.agent_report(e.agent_scores(answers(t)))
    return df.select("scope", F.coalesce("category", "difficulty", F.lit("")).alias("name"), "total", "n_passed", r6("pass_rate"), r6("avg_score"), F.size("failed_ids").cast("long").alias("n_failed"))


def tool_results(t):
    """Tool payloads of four shapes that carry document fields."""
    doc = F.struct(
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("C"), F.col("doc_id") % 40)).alias("id"), F.col("text").alias("content"),
        F.struct(F.expr("CASE doc_id % 3 WHEN 0 THEN 'numbered_formula' WHEN 1 THEN 'Algorithm' ELSE 'figure' END").alias("chunk_type"), F.expr("concat(doc_id % 7, '.', doc_id % 11)").alias("entity_id"), F.col("lang").alias("part_title"), F.col("source").alias("section_title"), (F.col("doc_id") % 90).alias("page")).alias("metadata"),
    )
    df = t.documents.withColumn("d", F.to_json(F.array(doc)))
    payload = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('{\"documents\":', d, '}') WHEN 1 THEN concat('{\"results\":', d, '}') WHEN 2 THEN concat('{\"expanded\":', d, '}') ELSE d END")
    return df.select(F.col("doc_id").alias("call_id"), F.lit("search").alias("tool_name"), F.lit('{"number":"1.1"}').alias("arguments"), payload.alias("payload"))


NORM = """, nr AS (SELECT doc_id AS call_id, CASE WHEN doc_id % 5 <> 0 THEN concat('C', doc_id % 40) END AS chunk_id, CASE doc_id % 3 WHEN 0 THEN 'formula' WHEN 1 THEN 'algorithm' ELSE 'image' END AS entity_type, concat(doc_id % 7, '.', doc_id % 11) AS entity_number, nullif(trim(lang), '') AS part_title, nullif(trim(source), '') AS section_title, CAST(doc_id % 90 AS INT) AS page FROM documents)"""


@query("e14_normalize_results", [], NORM + " SELECT call_id, chunk_id, entity_type, entity_number, part_title, section_title, page FROM nr")
def e14(t):
    return e.normalize_results(tool_results(t)).select("call_id", "chunk_id", "entity_type", "entity_number", "part_title", "section_title", "page")


@query("e8_extract_citations", [], NORM + """
, ci AS (SELECT call_id % 25 AS conv_id, call_id AS turn, coalesce(chunk_id, concat(entity_type, ':', entity_number)) AS chunk_id, CASE WHEN part_title = section_title THEN part_title ELSE concat_ws(' / ', part_title, section_title) END AS title, CASE WHEN page >= 1 THEN page END AS page, entity_type, entity_number FROM nr)
SELECT conv_id, chunk_id, title, page, entity_type, entity_number FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_id ORDER BY turn) AS rn FROM ci) WHERE rn = 1""")
def e8(t):
    docs = e.normalize_results(tool_results(t)).withColumns({"conv_id": F.col("call_id") % 25, "turn": F.col("call_id")})
    return e.extract_citations(docs)


FORMULA_TEXT = r"concat(coalesce(text, ''), ' $$ x', doc_id % 5, ' = y_', doc_id, ' $$ and $p(a) + ', doc_id % 3, '$ and $$x', doc_id % 5, '  = y_', doc_id, '$$ \begin{equation}\sum_', doc_id % 2, '\end{equation}')"


@query("e9_extract_formulas", [], ", tx AS (SELECT doc_id, " + FORMULA_TEXT + r""" AS body FROM documents),
-- a dollar sign beside another one fences no inline formula: it is set aside by a sign of its own
ap AS (SELECT *, array_to_string(list_transform(regexp_extract_all(body, '(?s)[$]+|[^$]+'), lambda x: CASE WHEN starts_with(x, '$$') THEN repeat(chr(2), length(x)) ELSE x END), '') AS single FROM tx),
al AS (SELECT doc_id, list_concat(regexp_extract_all(body, '(?s)\$\$(.*?)\$\$', 1), regexp_extract_all(body, '(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}', 1), regexp_extract_all(body, '(?s)\\begin\{align\*?\}(.*?)\\end\{align\*?\}', 1),
  list_transform(regexp_extract_all(single, '(?s)\$(.*?)\$', 1), lambda x: replace(x, chr(2), '$'))) AS f FROM ap),
un AS (SELECT doc_id, unnest(range(len(f))) AS i, trim(unnest(f)) AS latex FROM al),
dd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(latex, '\s+', '', 'g') ORDER BY i) AS rn FROM un WHERE length(latex) >= 3)
SELECT doc_id, latex, CASE WHEN contains(lower(latex), 'p(') OR contains(lower(latex), 'pr(') THEN 'Probability expression' WHEN contains(lower(latex), '\sum') THEN 'Summation expression' WHEN contains(lower(latex), '\int') THEN 'Integral expression'
  WHEN contains(lower(latex), '\frac') THEN 'Fraction or ratio expression' WHEN contains(latex, '=') THEN 'Equation' ELSE 'Mathematical expression' END AS label FROM dd WHERE rn = 1""")
def e9(t):
    df = t.documents.withColumn("body", F.expr(FORMULA_TEXT.replace("\\", "\\\\")))
    return e.extract_formulas(df, "doc_id", "body").select("doc_id", "latex", "label")


# fences stand after the text only: no given text holds one
@query("e10_extract_code", [], """
, fc AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest([0, 1, 2]) AS position, doc_id % 9 AS m FROM documents)
SELECT doc_id, CAST(position AS INT) AS position, CASE position WHEN 0 THEN 'python' WHEN 1 THEN 'julia' ELSE 'text' END AS language, position = 0 AS is_valid, CASE WHEN position = 0 THEN concat('m', m) ELSE '' END AS dependencies FROM fc""")
def e10(t):
    body = F.concat(F.coalesce("text", F.lit("")), F.expr(r"concat('\n```python\nimport m', doc_id % 9, '\nx = ', doc_id, '\n```\n```\nfunction f(x)\n x\nend\n```\n```py\nx = (\n```\n```python\nimport m', doc_id % 9, '\nx =  ', doc_id, '\n```')"))
    df = e.extract_code(t.documents.withColumn("body", body), "doc_id", "body")
    return df.select("doc_id", "position", "language", "is_valid", joined("dependencies"))


@query("e11_iteration_history", [], """
, cv AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role, text FROM conversations),
ld AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS iteration FROM cv WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(iteration AS INT) AS iteration, md5(text) AS thought, md5(CASE WHEN nr = 'tool' THEN nt END) AS observation FROM ld WHERE role = 'assistant'""")
def e11(t):
    df = e.iteration_history(t.conversations.withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))))
    return df.select("conv_id", "turn", "iteration", F.md5("thought").alias("thought"), F.md5("observation").alias("observation"))


@query("e12_trace_item_counts", [], "SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN doc_id % 13 WHEN 1 THEN doc_id % 6 + 1 WHEN 2 THEN 3 ELSE 1 END AS INT) AS n_items FROM documents")
def e12(t):
    payload = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('{\"meta\":{\"trace_count\":', doc_id % 13, ',\"count\":99},\"data\":[1]}') WHEN 1 THEN concat('{\"meta\":{\"count\":', doc_id % 6 + 1, '},\"data\":[]}') WHEN 2 THEN '[1,2,3]' ELSE '{\"data\":{\"x\":1}}' END")
    return e.trace_item_counts(t.documents.withColumn("payload", payload)).select("doc_id", "n_items")


@query("e13_quality_warnings", [], """
SELECT conv_id, turn, concat_ws(',', CASE WHEN turn > 5 THEN 'incomplete' END, CASE WHEN conv_id % 3 = 0 THEN 'no_algorithm' END, CASE WHEN role = 'user' THEN 'failed_tools' END, CASE WHEN conv_id % 4 = 1 THEN 'low_confidence' END) AS warnings FROM conversations""")
def e13(t):
    runs = t.conversations.select("conv_id", "turn", F.when(F.col("turn") > 5, "max_iterations").otherwise("completed").alias("status"), F.expr("CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END").alias("algorithm"), F.expr("CASE WHEN role = 'user' THEN array(role) ELSE array() END").alias("failed_tools"), F.expr("CASE WHEN conv_id % 4 = 1 THEN 'low' ELSE 'high' END").alias("confidence"))
    return e.quality_warnings(runs).select("conv_id", "turn", joined("warnings"))


def streamed(t, twin, keys):
    """Run a twin over the events as a stream until they are used up. Each batch appends the rows that it
    changed; of each key the row of the last batch holds."""
    spark = t.spark
    schema = t.events.schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/events.parque[t]")
    obs = raw.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS observed_at", "concat('D', user_id) AS device_id", "concat('P', event_id % 200) AS product_id", "concat('N', event_id % 25) AS location_id",
        "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS observed_qty", "CAST(get_json_object(props, '$.k') AS INT) / CAST(100 AS DOUBLE) AS confidence", "event_type = 'error' AS is_missing",
    )
    # files of one table come in any order: rows may be as late as its month of events is long
    return twins.run_to_table(twin(obs, "40 days"), keys, f"{shared_folder(spark)}/{twin.__name__}-{uuid.uuid4().hex}")


@query("x1_stream_latest_snapshot", [], """
, ob AS (SELECT event_id, ts, concat('D', user_id) AS device_id, concat('P', event_id % 200) AS product_id, concat('N', event_id % 25) AS location_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS observed_qty, CAST(json_extract_string(props, '$.k') AS INT) / CAST(100 AS DOUBLE) AS confidence FROM events)
SELECT product_id, location_id, epoch_us(ts) AS observed_at, event_id, observed_qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id, location_id ORDER BY ts DESC, confidence DESC NULLS LAST, event_id) AS rn FROM ob) WHERE rn = 1""")
def x1(t):
    return streamed(t, twins.stream_latest_snapshot, ["product_id", "location_id"]).select("product_id", "location_id", us("observed_at"), "event_id", "observed_qty")


@query("x2_stream_device_health", [], """
, wn AS (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01 00:00:00') - to_hours(unnest(range(24))) AS window_start FROM events)
SELECT epoch_us(window_start) AS window_start, concat('D', user_id) AS device_id, count(*) AS n_obs, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_missing, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS missing_rate FROM wn GROUP BY ALL""")
def x2(t):
    panes = streamed(t, twins.stream_device_panes, ["pane_start", "device_id"])
    return twins.windows_of_panes(panes).select(us("window_start"), "device_id", "n_obs", "n_missing", r6("missing_rate"))

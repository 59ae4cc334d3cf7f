"""Personal data: base patterns with positions, and information-theoretic sanitisation.

Base spans (e-mail, IP, card and phone numbers) are found by column expressions only: the text is
split at the matches of a pattern, and lengths of gaps and matches add up to positions.

Then terms that give a protected entity away are found. An entity is a *mention*, the value of a base
match, or a *class*, any match of one kind. A term and an entity co-occur in a text that holds both,
wherever they stand. Over different texts the corpus tells how strongly the term reveals the entity:
``PMI(term; entity) = log2(N * co / (df_term * df_entity))``, set against the entity's own information
``IC = log2(N / df_entity)``. A term that carries at least ``widen`` of it is generalised, one that
carries at least ``remove`` of it is removed, at every place of the texts that hold the entity. By
chance ``co`` texts with a term would all hold an entity with probability ``2 ** (-co * IC)``; the
evidence must leave less than ``chance`` such cases among all pairs that were tried, so how many texts
are needed follows from the data. Copies of a text count once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, if_small

#: Fixed patterns, by kind in the order in which spans of one start are listed. Possessive forms of
#: the plain patterns: they match the same and never backtrack over a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter runs of digits cannot pass, and a run is never entered in its middle
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}_]+"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def matches(text: Column, pattern: str, at_once: int = 512) -> Column:
    """array<struct<start, value>> of leftmost non-overlapping matches, in code points.

    Gaps and matches are added up for some at a time and shifted then, so work grows with their number.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / at_once).cast("int")), lambda j: F.slice(pieces, j * at_once + 1, F.lit(at_once)))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("found"))

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        more = F.array(F.struct(start.alias("start"), p["value"].alias("value")))
        return F.when(p["value"].isNull(), F.struct(start.alias("at"), acc["found"].alias("found"))).otherwise(
            F.struct((start + F.length(p["value"])).alias("at"), F.concat(acc["found"], more).alias("found"))
        )

    def shift(acc, part):
        moved = F.transform(part["found"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), m["value"].alias("value")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    laid = F.transform(parts, lambda part: F.aggregate(part, nothing, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,value:string>>>").alias("found"))
    return F.flatten(F.aggregate(laid, none, shift)["found"])


def spans_of(text: Column, rank: int, kind: str) -> Column:
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: passes(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind."""
    parts = []
    for rank, kind in enumerate(KINDS):
        spans = spans_of(text, rank, kind)
        there = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(PATTERNS[kind])
        parts.append(F.when(there, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms of a text outside base patterns. A pattern is consumed as a whole, so its
    parts are no terms; what is longer than three characters and all letters, digits or _ is one."""
    found = F.regexp_extract_all(text, F.lit("|".join([*PATTERNS.values(), TERM])), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, is_term), F.lower))


def is_term(x: Column) -> Column:
    return (F.length(x) >= 3) & x.rlike(rf"^{TERM}$")


def entities_of(base: str) -> Column:
    """Distinct mentions (kind:value) and classes (kind) of a text."""
    return F.array_distinct(F.concat(F.transform(base, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))), F.transform(base, lambda s: s["kind"])))


def revealing_terms(rows: DataFrame, found: DataFrame, min_support: int, widen: float, remove: float, chance: float, max_broadcast: int) -> DataFrame:
    """(entity, term, action) of the terms that disclose too much.

    ``rows``: (text_hash, text); ``found``: (text_hash, base) of the same rows. Equal texts have one hash.
    """
    held = durable(found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base")))
    n_texts = max(1, held.count())
    holders = held.where(F.size("base") > 0).select("text_hash", "n", F.explode(entities_of("base")).alias("entity"))
    known = durable(holders.groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity")).where(F.col("df_entity") >= min_support))
    # only texts of entities that could have evidence are searched for their terms
    asked = durable(holders.join(if_small(known.select("entity"), 64, max_broadcast), "entity").groupBy("text_hash").agg(F.first("n").alias("n"), F.collect_list("entity").alias("entities")))
    near = rows.join(if_small(asked, 128, max_broadcast), "text_hash").select("n", "entities", F.explode(terms_of(F.col("text"))).alias("term"))
    pairs = near.select(F.explode("entities").alias("entity"), "term", (1.0 / F.col("n")).alias("share")).groupBy("entity", "term").agg(F.round(F.sum("share")).alias("co"))
    pairs = durable(pairs.where(F.col("co") >= min_support).join(if_small(known, 64, max_broadcast), "entity"))
    n_pairs = max(1, pairs.count())
    # n copies of a text count 1 / n each; words are summed before they meet the pairs
    copies = if_small(held.where("n > 1").select("text_hash", "n"), 16, max_broadcast)
    weighed = rows.join(copies, "text_hash", "left").withColumn("share", 1.0 / F.coalesce("n", F.lit(1)))
    words = weighed.select("share", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    spread = words.groupBy("term").agg(F.round(F.sum("share")).alias("df_term"))
    told = pairs.join(spread, "term")
    information = F.log2(F.lit(float(n_texts)) / F.col("df_entity"))
    pmi = F.log2(F.lit(float(n_texts)) * F.col("co") / (F.col("df_term") * F.col("df_entity")))
    told = told.withColumn("part", F.try_divide(pmi, information)).where((F.col("part") >= widen) & (F.col("co") * information >= math.log2(n_pairs / chance)))
    return durable(told.select("entity", "term", F.when(F.col("part") >= remove, "removed").otherwise("widened").alias("action")))


def personal_data(docs: DataFrame, min_support: int = 3, widen: float = 0.85, remove: float = 0.95, chance: float = 0.01, max_broadcast: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, base, extra.

    ``base``: base spans by start and kind. ``extra``: spans of revealing terms, kind ``removed`` or
    ``widened`` (removal wins where both apply); they lie outside base patterns. Null texts count as
    empty and have no spans. Repeated rows each get a row. Empty tables give empty tables; other columns
    are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = durable(rows.select("doc_id", "text_hash", base_spans(F.col("text")).alias("base")))
    told = revealing_terms(rows.select("text_hash", "text"), found.select("text_hash", "base"), min_support, widen, remove, chance, max_broadcast)
    none = F.array().cast(SPAN)
    if told.isEmpty():
        return found.select("doc_id", "text_hash", "base", none.alias("extra"))
    # a text's own terms meet what was told of them; it counts if the text holds the entity
    holders = found.where(F.size("base") > 0).groupBy("text_hash").agg(F.first("base").alias("base")).select("text_hash", F.explode(entities_of("base")).alias("entity"))
    holders = durable(holders.join(if_small(told.select("entity").distinct(), 64, max_broadcast), "entity", "left_semi"))
    texts = rows.join(if_small(holders.select("text_hash").distinct(), 16, max_broadcast), "text_hash", "left_semi").select("text_hash", F.explode(terms_of(F.col("text"))).alias("term"))
    acts = texts.join(if_small(told, 96, max_broadcast), "term").distinct().join(holders, ["text_hash", "entity"], "left_semi").groupBy("text_hash", "term").agg(F.min("action").alias("action"))
    acts = durable(acts)
    wanted = if_small(acts.select("text_hash").distinct(), 16, max_broadcast)
    spots = rows.join(wanted, "text_hash", "left_semi").select("text_hash", F.explode(term_places(F.col("text"))).alias("t")).select("text_hash", "t.*").distinct()
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.col("action").alias("kind"), "end", F.col("term").alias("value"))
    extra = spots.join(acts, ["text_hash", "term"]).groupBy("text_hash").agg(F.array_sort(F.collect_list(span)).alias("extra"))
    return found.join(extra, "text_hash", "left").select("doc_id", "text_hash", "base", F.coalesce("extra", none).alias("extra"))


def term_places(text: Column) -> Column:
    """Terms of a text with their places, in code points."""
    found = F.filter(matches(text, "|".join([*PATTERNS.values(), TERM])), lambda m: is_term(m["value"]))
    return F.transform(found, lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitize(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, clean_text): entities become ``[EMAIL]`` and the like, removed terms ``[...]``, widened
    terms their shape: ``[NUMBER]``, ``[NAME]`` or ``[TERM]``. Of overlapping spans the first wins.
    Row rules are those of ``personal_data``."""
    found = personal_data(docs, **options).dropDuplicates(["doc_id", "text_hash"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    both = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash"))).select("r.doc_id", "r.text", F.array_sort(F.concat("base", "extra")).alias("spans"))

    def step(acc, s):
        original = F.substring(F.col("text"), s["start"] + 1, F.length(s["value"]))
        shape = F.when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").when(original.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        mask = F.when(s["kind"] == "removed", "[...]").when(s["kind"] == "widened", shape).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), mask)
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return both.select("doc_id", clean.alias("clean_text"))

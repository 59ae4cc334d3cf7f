"""Reference graph of chunks, its quality checks, and the graph of code in them."""

from __future__ import annotations

import ast
import gc
import keyword
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import labels
from ..functions.durable import durable, written
from ..functions.python import ship
from ..functions.scan import BLOCK, running

ship(__name__)

#: The chunk type that each reference field points to.
TARGETS = {
    "referenced_algorithms": "algorithm",
    "referenced_examples": "example",
    "referenced_exercises": "exercise",
    "referenced_figures": "captioned_image",
    "referenced_formulas": "numbered_formula",
    "referenced_tables": "numbered_table",
}


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """Name-based UUID of version 5, from SHA-1 by column functions alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def deterministic_uuid(df: DataFrame) -> DataFrame:
    """uuid of ``entity_id:chunk_type``, or of the content where there is no entity."""
    entity = F.coalesce("entity_id", F.lit(""))
    return df.withColumn("uuid", uuid5(F.when(entity != "", F.concat_ws(":", "entity_id", "chunk_type")).otherwise(F.concat_ws(":", "chunk_type", "content"))))


def references(chunks: DataFrame) -> DataFrame:
    """One row for each reference: src, field, entity_id, chunk_type."""
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("chunk_type"), F.coalesce(f, F.array().cast("array<string>")).alias("ids")) for f, t in TARGETS.items()])
    df = chunks.select(F.col("chunk_id").alias("src"), F.explode(items).alias("r"))
    return df.select("src", "r.field", "r.chunk_type", F.explode("r.ids").alias("entity_id"))


def target_map(chunks: DataFrame) -> DataFrame:
    """(entity_id, chunk_type) -> chunk; of duplicates the last loaded wins."""
    return chunks.where("entity_id is not null").groupBy("entity_id", "chunk_type").agg(F.max_by("chunk_id", "load_order").alias("dst"))


def reference_edges(chunks: DataFrame) -> DataFrame:
    """Resolved references: src, field, dst."""
    return references(chunks).join(target_map(chunks), ["entity_id", "chunk_type"]).select("src", "field", "dst")


def chunk_objects(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks as objects of a vector store: uuid, chunk_id, chunk_type, content, embedding, links.

    ``vectors``: (chunk_id, embedding); a chunk without one has a null embedding. ``links`` lists field and
    uuid of every chunk that is referred to, in order. Unknown targets are left out.
    """
    ids = deterministic_uuid(chunks).select("chunk_id", "uuid")
    edges = reference_edges(chunks).join(ids.select(F.col("chunk_id").alias("dst"), F.col("uuid").alias("target")), "dst")
    links = edges.groupBy(F.col("src").alias("chunk_id")).agg(F.array_sort(F.collect_set(F.struct("field", "target"))).alias("links"))
    df = chunks.select("chunk_id", "chunk_type", "content").join(ids, "chunk_id").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left").join(links, "chunk_id", "left")
    return df.select("uuid", "chunk_id", "chunk_type", "content", "embedding", F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))


def dangling_references(chunks: DataFrame) -> DataFrame:
    """References without a target."""
    return references(chunks).join(target_map(chunks), ["entity_id", "chunk_type"], "left_anti").select("src", "field", "chunk_type", "entity_id")


def entity_gaps(chunks: DataFrame) -> DataFrame:
    """Missing numbers of each (type, parent), from 1 to the last; only where all tails are numeric."""
    parts = chunks.where("entity_id is not null").select("chunk_type", F.regexp_extract("entity_id", r"^(.*)\.[^.]*$", 1).alias("parent"), F.regexp_extract("entity_id", r"([^.]*)$", 1).alias("tail"))
    good = parts.groupBy("chunk_type", "parent").agg(F.bool_and(F.col("tail").rlike(r"^\d+$")).alias("numeric")).where("numeric")
    nums = parts.join(good.select("chunk_type", "parent"), ["chunk_type", "parent"]).select("chunk_type", "parent", F.col("tail").cast("int").alias("n")).distinct()
    w = Window.partitionBy("chunk_type", "parent").orderBy("n")
    before = F.coalesce(F.lag("n").over(w), F.lit(0))
    return nums.withColumn("before", before).where("n > before + 1").select("chunk_type", "parent", F.explode(F.sequence(F.col("before") + 1, F.col("n") - 1)).alias("missing"))


def invalid_entity_ids(chunks: DataFrame) -> DataFrame:
    """Missing or malformed entity ids; text has none by nature."""
    df = chunks.where("chunk_type <> 'text'")
    bad = F.when(F.col("entity_id").isNull() | (F.col("entity_id") == ""), "missing").when(~F.col("entity_id").rlike(r"^[A-Z\d]+(\.\d+)+$"), "malformed")
    return df.withColumn("problem", bad).where("problem is not null").select("chunk_id", "chunk_type", "entity_id", "problem")


def duplicate_entity_ids(chunks: DataFrame) -> DataFrame:
    return chunks.where("entity_id is not null").groupBy("chunk_type", "entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def hierarchy_issues(chunks: DataFrame) -> DataFrame:
    """Numbers without titles and levels without their upper level."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    found = labels(
        (has("section_number") & ~has("section_title"), "section_without_title"),
        (has("subsection_number") & ~has("subsection_title"), "subsection_without_title"),
        (has("subsubsection_number") & ~has("subsubsection_title"), "subsubsection_without_title"),
        (has("subsection_number") & ~has("section_number"), "subsection_without_section"),
        (has("subsubsection_number") & ~has("subsection_number"), "subsubsection_without_subsection"),
    )
    return chunks.select("chunk_id", F.explode(found).alias("issue"))


def natural_key(value: Column) -> Column:
    """Parts of an id; numbers before letters, numbers by value."""
    return F.transform(F.split(value, r"\."), lambda p: F.struct(F.when(p.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("long"), F.lit(0)).alias("number"), p.alias("text")))


def distinct_references(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ids of each reference field with their place in natural order. Fields of more than ``block`` ids
    are ranked in ranges."""
    df = references(chunks).select("field", "entity_id").distinct()
    return running(df, ["field"], [natural_key(F.col("entity_id"))], {"place": F.lit(1)}, block=block)


def parent_chunk_link(chunks: DataFrame) -> DataFrame:
    """defined_in_chunk resolved to the parent's uuid; unknown parents are cleared."""
    known = deterministic_uuid(chunks).select(F.col("chunk_id").alias("defined_in_chunk"), F.col("uuid").alias("parent_uuid"))
    return chunks.join(known, "defined_in_chunk", "left").withColumn("defined_in_chunk", F.when(F.col("parent_uuid").isNotNull(), F.col("defined_in_chunk")))


def small_parts(batches, column: int, most: int = 1 << 20):
    """Slices of batches whose texts in ``column`` have some ``most`` bytes together, or one longer text.

    Syntax trees take many times the room of a text, so a worker never holds those of a whole batch. Trees
    have no cycles: no garbage is collected while a slice is worked on.
    """
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
            was_on = gc.isenabled()
            gc.disable()
            try:
                yield batch.slice(first, end - first)
            finally:
                if was_on:
                    gc.enable()
            first = end


#: Four or more plain names and nothing else in the parentheses of a call, a signature or the like.
PLAIN_NAMES = re.compile(r"(?<=\w\()(?:[A-Za-z_]\w*, ){3,}+[A-Za-z_]\w*+(?=\))", re.A)
KEYWORDS = frozenset(keyword.kwlist)


def two_names(found: re.Match) -> str:
    names = found[0].split(", ")
    return ", ".join(names[:2]) if KEYWORDS.isdisjoint(names) else found[0]


def code_rows(source: str) -> list[tuple[str, str, str | None]]:
    """(kind, name, detail) of one fragment: class, method, function and call rows.

    Long lists of plain names are parsed as their first two: wherever Python takes two names in parentheses
    it takes more, names call nothing, and what strings and comments hold is not asked for.
    """
    try:
        tree = ast.parse(PLAIN_NAMES.sub(two_names, source))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, str, str | None]] = []

    def calls(node, owner):
        left = [node]
        while left:
            for value in vars(left.pop()).values():
                for n in value if isinstance(value, list) else (value,):
                    # names and constants hold nothing, and most nodes are names
                    if not isinstance(n, ast.AST) or isinstance(n, ast.Name | ast.Constant):
                        continue
                    left.append(n)
                    if isinstance(n, ast.Call):
                        f = n.func
                        if isinstance(f, ast.Name):
                            out.append(("call", owner, f.id))
                        elif isinstance(f, ast.Attribute):
                            base = f.value.id if isinstance(f.value, ast.Name) else "?"
                            out.append(("call", owner, f"{base}.{f.attr}"))

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append(("class", node.name, None))
            for m in node.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    out.append(("method", f"{node.name}.{m.name}", node.name))
                    calls(m, f"{node.name}.{m.name}")
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(("function", node.name, None))
            calls(node, node.name)
    return out


def code_entities(fragments: DataFrame) -> DataFrame:
    """fragments: fragment_id, code -> fragment_id, kind, name, detail. Invalid fragments give no rows."""

    def batches(it):
        for batch in small_parts(it, 1):
            rows = [(i, *r) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in code_rows(c or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["fragment_id", "kind", "name", "detail"])

    return fragments.select(F.col("fragment_id").cast("string"), "code").mapInArrow(batches, "fragment_id string, kind string, name string, detail string")


def call_graph(entities: DataFrame) -> DataFrame:
    """Calls resolved to definitions: caller, callee, kind.

    A call goes to the definition of its full name (for self, in the caller's class), a class before a
    function; else to the method of that short name, if it is the only one. Both steps are joins on a
    unique name, so a method name that every class has is no hot key.
    """
    defs = entities.where("kind <> 'call'").groupBy(F.col("name").alias("target")).agg(F.min("kind").alias("target_kind"))
    calls = entities.where("kind = 'call'").select(F.col("name").alias("caller"), F.col("detail").alias("raw"))
    owner, short = F.regexp_extract("caller", r"^([^.]+)\.", 1), F.substring_index("raw", ".", -1)
    full = F.when(F.col("raw").startswith("self.") & (owner != ""), F.concat(owner, F.lit("."), short)).otherwise(F.col("raw"))
    calls = calls.select("caller", full.alias("target"), short.alias("short")).distinct()
    # both steps read what the first join found, so calls are shuffled for it once
    found = written(calls.join(defs, "target", "left").select("caller", "target", "target_kind", F.when(F.col("target_kind").isNull(), F.col("short")).alias("short")), "found")
    only = entities.where("kind = 'method'").select(F.col("name").alias("target")).distinct().groupBy(F.substring_index("target", ".", -1).alias("short")).agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1")
    other = found.where("target_kind is null").select("caller", "short").join(only, "short").select("caller", "target", F.lit("method").alias("target_kind"))
    return found.where("target_kind is not null").select("caller", "target", "target_kind").union(other).distinct().select("caller", F.col("target").alias("callee"), F.col("target_kind").alias("kind"))


def code_schema(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """Definitions with a stable id and the ids they call by kind."""
    ids = entities.where("kind <> 'call'").groupBy("kind", "name").agg(F.min("detail").alias("class_ref"), F.min("fragment_id").alias("fragment_id")).withColumn("id", uuid5(F.concat_ws(":", "kind", "name")))
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, uuid5(F.concat_ws(":", "kind", "callee")))))
    refs = calls.groupBy(F.col("caller").alias("name")).agg(of("class").alias("referenced_classes"), of("method").alias("referenced_methods"), of("function").alias("referenced_functions"))
    none = F.array().cast("array<string>")
    return ids.join(refs, "name", "left").withColumns({c: F.coalesce(c, none) for c in ("referenced_classes", "referenced_methods", "referenced_functions")})


FENCE = r"(?s)```[ \t]*[\w+-]*[ \t]*\n(.*?)```"


def code_blocks(text: str) -> list[str]:
    """Code in prose: the whole text if it parses, else fences, else runs of lines that look like code."""
    try:
        if ast.parse(text).body and re.search(r"[=(:]", text):
            return [text]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    fenced = re.findall(FENCE, text)
    if fenced:
        return fenced
    out, run = [], []
    for line in text.split("\n"):
        if re.match(r"^\s*(def |class |return |for |if |while |import |from |[A-Za-z_][\w.]*\s*=\s*\S|[A-Za-z_][\w.]*\()", line) or (run and line.startswith((" ", "\t"))):
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    return out + (["\n".join(run)] if run else [])


def names_used(block: str) -> set[str]:
    """Qualified and short names in a block; by syntax if it parses, else by pattern."""
    try:
        tree = ast.parse(block)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return set(re.findall(r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*\(", block))
    out = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Name):
            out.add(n.id)
        elif isinstance(n, ast.Attribute):
            out.add(n.attr)
            if isinstance(n.value, ast.Name):
                out.add(f"{n.value.id}.{n.attr}")
    return out


def code_refs(chunks: DataFrame, schema: DataFrame) -> DataFrame:
    """Definitions used by the code in each chunk: chunk_id, kind, name, id."""

    def batches(it):
        for batch in small_parts(it, 1):
            rows = [(i, n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in sorted({n for b in code_blocks(t or "") for n in names_used(b)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["chunk_id", "used"])

    used = chunks.select(F.col("chunk_id").cast("string"), "content").mapInArrow(batches, "chunk_id string, used string")
    return used.join(schema.select("kind", "name", "id"), F.col("used") == F.col("name")).select("chunk_id", "kind", "name", "id").distinct()


def usage_index(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Where each declared name is used in other blocks. blocks: block_id, code; declared: block_id, name.

    The line that declares a name is no use of it; a block does not use what it declares itself.
    """
    lines = F.filter(F.split("code", "\n"), lambda line: ~line.rlike(r"^\s*(def|class|struct|function|mutable struct)\s"))
    names = F.array_distinct(F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))))
    tokens = blocks.select("block_id", F.explode(names).alias("name"))
    d = declared.select("name", F.col("block_id").alias("home")).distinct()
    return tokens.join(d, "name").where("block_id <> home").select("name", "home", F.col("block_id").alias("used_in")).distinct()


def related_definitions(usage: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """For each block the definitions it needs; with chapters (block_id, chapter) only earlier ones."""
    df = usage.select(F.col("used_in").alias("block_id"), "name", "home")
    if chapters is None:
        return df
    here, there = chapters.select("block_id", "chapter"), chapters.select(F.col("block_id").alias("home"), F.col("chapter").alias("home_chapter"))
    return df.join(here, "block_id").join(there, "home").where("home_chapter < chapter").select("block_id", "name", "home")


def code_closure(roots: DataFrame, calls: DataFrame, max_depth: int = 5, algorithms: DataFrame | None = None) -> DataFrame:
    """Definitions reachable from root names: root, name, depth (the longest found up to the bound).

    Frontiers are distinct (root, name) rows, so cycles end at the bound; ``callgraph.callees_first`` puts what
    is found in order, whatever circles it holds. ``algorithms``: (name, algorithm); a definition that belongs
    to an algorithm which is itself among the roots is not entered, as it comes with that one. Edges and
    levels are kept, so none is made twice.
    """
    edges = calls.select(F.col("caller").alias("name"), F.col("callee").alias("next")).distinct()
    if algorithms is not None:
        held = algorithms.join(roots.select(F.col("root").alias("algorithm")).distinct(), "algorithm", "left_semi").select(F.col("name").alias("next"))
        edges = edges.join(held, "next", "left_anti").select("name", "next")
    edges = durable(edges)
    level = durable(roots.select("root", "name").distinct().withColumn("depth", F.lit(0)))
    out = level
    for depth in range(1, max_depth + 1):
        level = durable(level.join(edges, "name").select("root", F.col("next").alias("name"), F.lit(depth).alias("depth")).distinct())
        out = out.union(level)
    return out.groupBy("root", "name").agg(F.max("depth").alias("depth"))


def assemble_source(closure: DataFrame, sources: DataFrame) -> DataFrame:
    """One source text for each root: callees first, methods under their class at its deepest member.

    sources: name, class_ref, code.
    """
    df = closure.join(sources.select("name", "class_ref", "code"), "name").withColumn("block", F.coalesce("class_ref", "name"))
    member = F.struct((F.col("class_ref").isNotNull()).cast("int").alias("m"), (-F.col("depth")).alias("d"), "name", "code")
    blocks = df.groupBy("root", "block").agg(F.max("depth").alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["code"]), "\n").alias("code"))
    item = F.struct((-F.col("depth")).alias("d"), "block", "code")
    return blocks.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["code"]), "\n\n").alias("source"), F.count(F.lit(1)).alias("n_blocks"))

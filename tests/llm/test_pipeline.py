"""The pipeline's stages on a small folder, against what each must do."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as h  # noqa: E402
from test_ops import changed, prose, toxic_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from stockops.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("tables")
    rows, labels = toxic_rows(400)
    leak = prose(20, rng)
    base = prose(250, rng)
    rows += [(1000, base, "s"), (1001, base, "t"), (1002, changed(base, 1, rng), "s"), (1010, f"{prose(30, rng)} {leak} {prose(30, rng)}", "t"), (1020, None, "t"), (1021, "", "s")]
    h.documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    talks = [(c, t, "user", f"turn {t if t < 2 else c}") for c in range(8) for t in range(4)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 3) for i in range(50)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    toxic, clean = {i for i in range(0, 400, 5)}, {i for i in range(400) if i % 5}
    assert len(toxic & set(ids["toxicity"])) <= 2 and len(clean - set(ids["toxicity"])) <= 2
    assert {1000, 1001, 1002} & set(ids["near_duplicates"]) == {1000} and clean & set(ids["toxicity"]) <= set(ids["near_duplicates"])
    assert 1010 not in ids["decontamination"] and set(ids["decontamination"]) == set(ids["near_duplicates"]) - {1010}
    words = lambda df: sum(len(h.words(r.text)) for r in df.collect())
    assert abs(words(seen["mixing"]) - words(seen["decontamination"])) < 0.1 * words(seen["decontamination"])
    assert seen["sharding"].columns == [*columns, "shard"]
    assert sorted(map(str, seen["sharding"].drop("shard").collect())) == sorted(map(str, seen["mixing"].collect()))
    out = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, out.collect())) == sorted(map(str, seen["sharding"].collect()))


def test_stages_on_nulls_repeats_and_empty_tables(spark, folder):
    """Null ids, texts and sources, rows that repeat an id, clashing columns and no rows at all."""
    rng = random.Random(17)
    rows = [(None, prose(30, rng), None), (None, None, "s"), (1, prose(30, rng), "s"), (1, prose(30, rng), "t"), (2, "", None), (3, prose(6000, rng), "s")] + [(10 + i, prose(40, rng), "s") for i in range(20)]
    clash = dict.fromkeys(("row", "h", "fp", "component", "stays", "nr", "at", "whole", "size", "copies", "n_shards", "spans", "score", "words"), None)
    docs = h.documents(spark, rows).withColumns({c: F.lit(c) for c in clash})
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.drop("shard").columns == docs.columns
        assert stage(spark, docs.where("false"), folder).isEmpty()
        ids = [str(r.doc_id) for r in out.collect()]
        assert ids.count("1") >= 2 or stage is corpus_pipeline.mix
        assert {"3", *(str(10 + i) for i in range(20))} <= set(ids) or stage is corpus_pipeline.mix


def test_near_copies_that_are_caught(spark):
    """Recall over documents with one word in 40 changed, and clean documents left alone."""
    rng = random.Random(29)
    wide = [f"v{i}" for i in range(3000)]
    rows, copies = [], 0
    for i in range(150):
        w = [rng.choice(wide) for _ in range(rng.randrange(60, 400))]
        rows.append((i, " ".join(w), "s"))
        if i % 3 == 0:
            for k in range(rng.randrange(1, 4)):
                v = list(w)
                for _ in range(len(v) // 60):
                    v[rng.randrange(len(v))] = rng.choice(wide)
                rows.append((1000 + 10 * i + k, " ".join(v), "s"))
                copies += 1
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, h.documents(spark, rows), "").collect()}
    assert set(range(150)) <= kept and len(kept) - 150 <= 0.1 * copies


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    n = df.count()
    tables = {"op4_url_filter": "pages", "op9_substring_dedup": None, "op11_conversation_trie": None, "op12_neighbours": "embeddings", "op13_centroids": "embeddings"}
    table = tables.get(name, "documents")
    if table:
        assert n == spark.read.parquet(f"{folder}/{table}.parquet").count()

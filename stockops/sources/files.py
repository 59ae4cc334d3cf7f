"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.durable import written
from ..functions.python import ship

ship(__name__)


def read_json_corpus(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array (or one object a file) with a schema of its own: nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_database(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()


def upsert_parquet(current: DataFrame, changes: DataFrame, keys: list[str], path: str) -> None:
    """Current rows with changed keys replaced, written to a new path."""
    merged = current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)
    merged.write.mode("errorifexists").parquet(path)


def upsert_objects(objects: DataFrame, path: str, key: str = "uuid", buckets: int = 64) -> None:
    """Insert objects into a table of buckets of their key, or replace those of an equal key.

    Only buckets that receive objects are read and rewritten, and they are staged in the shared folder
    before any is replaced. Of objects of one key in ``objects`` the last by hash stays.
    """
    spark = objects.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = written(objects.withColumn("bucket", bucket), "objects")
    last = Window.partitionBy(key).orderBy(F.xxhash64(*[fresh[c] for c in objects.columns]))
    merged = fresh.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
    try:
        current = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = current.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")
        merged = merged.unionByName(touched.join(fresh.select(key).distinct(), key, "left_anti"))
    staged = written(merged, "staged")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def scenarios(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Parsed scenario records (few, written by hand) as rows with a JSON column for what is expected."""
    import json

    data = [(r["id"], r.get("category"), r.get("difficulty"), r.get("query"), json.dumps(r.get("expected_output", {}))) for r in rows]
    return spark.createDataFrame(data, "scenario_id string, category string, difficulty string, query string, expected string").withColumn("has_expected", F.col("expected") != "{}")


SCENARIO = ["scenario_id", "category", "difficulty", "query", "expected", "error"]


def parsed_scenarios(content: bytes) -> Iterator[tuple]:
    """Records of one YAML file: a record, a list of them, or either under ``scenarios``; several documents in a
    file follow one another. A file or record that is none of these gives one row that says why."""
    import json

    import yaml

    try:
        found = list(yaml.safe_load_all(content))
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        yield (None, None, None, None, None, f"not YAML: {type(e).__name__}")
        return
    for doc in found:
        doc = doc.get("scenarios", doc) if isinstance(doc, dict) else doc
        for r in doc if isinstance(doc, list) else [] if doc is None else [doc]:
            if not isinstance(r, dict) or r.get("id") is None:
                yield (None, None, None, None, None, "no record with an id")
                continue
            told = [None if r.get(c) is None else str(r[c]) for c in ("id", "category", "difficulty", "query")]
            yield (*told, json.dumps(r.get("expected_output") or {}, default=str, sort_keys=True), None)


def read_scenarios(spark: SparkSession, path: str, max_file_bytes: int = 16 << 20) -> DataFrame:
    """Scenarios of a folder of YAML files: path, position, scenario_id, category, difficulty, query, expected
    (JSON), error, has_expected.

    Spark lists and reads the files, from any store it knows, and files are parsed in parallel where they
    are read. Files above ``max_file_bytes``, that do not parse, or whose records have no id give rows with an
    ``error`` and stop nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.when(F.col("length") <= max_file_bytes, F.col("content")).alias("content"))

    def parse(it):
        for batch in it:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parsed_scenarios(content) if content is not None else [(None, None, None, None, None, "too long")]
                out += [(name, i, *r) for i, r in enumerate(found)]
            kinds = [pa.string(), pa.int32(), *[pa.string()] * len(SCENARIO)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["path", "position", *SCENARIO])

    df = rows.mapInArrow(parse, "path string, position int, " + ", ".join(f"{c} string" for c in SCENARIO))
    return df.withColumn("has_expected", F.coalesce(F.col("expected") != "{}", F.lit(False)))

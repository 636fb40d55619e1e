"""Reading snapshots of records and writing tables, reports, logs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill import shared

_TEXTS = "ARRAY<STRING>"
RECORD = (
    "schema_version STRING, identity STRUCT<canonical_name: STRING, canonical_id: STRING, version: STRING, ecosystem: STRING, ecosystem_id: STRING>, "
    f"descriptive STRUCT<summary: STRING, homepage: STRING, license: {_TEXTS}, categories: {_TEXTS}, maintainers: {_TEXTS}, deprecated: BOOLEAN, expiration_date: STRING>, "
    "sources ARRAY<STRUCT<type: STRING, url: STRING, sha256: STRING, integrity: STRING, filename: STRING, size: BIGINT>>, "
    f"dependencies STRUCT<build: {_TEXTS}, host: {_TEXTS}, runtime: {_TEXTS}, test: {_TEXTS}>, conflicts {_TEXTS}, "
    f"patches ARRAY<STRUCT<path: STRING, reason: STRING>>, platforms STRUCT<include: {_TEXTS}, exclude: {_TEXTS}>, "
    "provenance STRUCT<generated_by: STRING, imported_at: STRING, source_path: STRING, confidence: DOUBLE, unmapped: ARRAY<STRING>, warnings: ARRAY<STRING>>, stub BOOLEAN, behavioral_spec STRING"
)


def documents(spark: SparkSession, roots: list[str], pattern: str = "*.json", reports: bool = False) -> DataFrame:
    """_path, v (VARIANT) of every JSON document below the roots; manifest.json, what is no JSON and, unless asked for, all below a folder named reports is left out.

    Files are listed and read by Spark's reader, so any store it knows will do; hidden names (_x, .x) are not read.
    """
    files = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = files.select(F.col("_metadata.file_path").alias("_path"), F.try_parse_json("value").alias("v")).where(F.substring_index("_path", "/", -1) != "manifest.json")
    return rows.where("v IS NOT NULL") if reports else rows.where(F.col("v").isNotNull() & ~F.col("_path").contains("/reports/"))


#: What a snapshot does with records that have no name: they count under "unknown", or they are left out.
UNKNOWN, LEFT_OUT = "unknown", None


def snapshot(spark: SparkSession, roots: list[str], require_identity: bool = True, reports: bool = False, nameless: str | None = UNKNOWN, names: tuple[str, ...] = ("identity.canonical_name", "name", "pname")) -> DataFrame:
    """Records of snapshots in the RECORD schema, with _path, _name (the first of `names` that is given), _ord (by which merges order them: the path) and the document itself as v."""
    rows = documents(spark, roots, reports=reports)
    if require_identity:
        rows = rows.where(F.try_variant_get("v", "$.identity", "variant").isNotNull())
    get = lambda p: F.nullif(F.try_variant_get("v", f"$.{p}", "string"), F.lit(""))
    name = F.coalesce(*map(get, names), F.lit(nameless).cast("string"))
    found = rows.select("_path", name.alias("_name"), "v", F.from_json(F.to_json("v"), RECORD).alias("r")).select("_path", "_name", F.col("_path").alias("_ord"), "v", "r.*")
    return found if nameless is not None else found.where(F.col("_name").isNotNull())


def flat_documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """_path, v of the JSON objects that lie in a folder itself, not below it."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter=pattern)
    rows = files.select(F.col("_metadata.file_path").alias("_path"), F.try_parse_json("value").alias("v"))
    return rows.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def compiled_specs(spark: SparkSession, root: str, ending: str = ".spec.json") -> DataFrame:
    """spec, _path, v of compiled specifications by the ending of their files; the name is the document's canonical name, else the file's."""
    rows = flat_documents(spark, root, f"*{ending}")
    name = F.substring_index("_path", "/", -1)
    file = F.substring(name, F.lit(1), F.length(name) - len(ending))
    return rows.select(F.coalesce(F.nullif(F.try_variant_get("v", "$.identity.canonical_name", "string"), F.lit("")), file).alias("spec"), "_path", "v")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """id, passed, message, skip_reason of a run's results, a JSON list of objects in a file."""
    return spark.read.schema("id STRING, passed BOOLEAN, message STRING, skip_reason STRING").option("multiLine", "true").json(path).where("id IS NOT NULL")


def evaluated(spark: SparkSession, root: str) -> DataFrame:
    """attr, raw of batches of evaluated attributes: JSON objects {attr: {...}}, those that are null left out; of a repeated attribute each is a row."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    pairs = F.from_json("value", "map<string,string>")
    return files.select(F.explode(pairs).alias("attr", "raw")).where("raw IS NOT NULL AND raw <> 'null'")


def settings(*layers: dict) -> dict:
    """Layers of settings over each other, the later ones on top: mappings are merged key by key, anything else is replaced."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            below = out.get(key)
            out[key] = settings(below, value) if isinstance(below, dict) and isinstance(value, dict) else value
    return out


def read_settings(paths: list[str], defaults: dict | None = None) -> dict:
    """Defaults, then YAML files in their order; files that are missing are left out."""
    import os

    import yaml

    held = []
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held.append(yaml.safe_load(f) or {})
    return settings(defaults or {}, *held)


def names_file(spark: SparkSession, path: str) -> DataFrame:
    """name of every line of a list; comments (#) and blank lines go."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("name")).where("name <> ''")


def manifest(records: DataFrame) -> DataFrame:
    """ecosystem, n of a snapshot."""
    return records.groupBy(F.col("identity.ecosystem").alias("ecosystem")).agg(F.count("*").alias("n"))


def write_manifest(records: DataFrame, path: str) -> None:
    """The manifest as JSON lines, one file."""
    manifest(records).coalesce(1).write.mode("overwrite").json(path)


def export_records(rows: DataFrame, path: str, name: str = "_name") -> None:
    """Documents (v) as JSON texts, one row a document, dealt by the first letters of the name so that a reader of some names skips files.

    Keys are sorted. Spark's writer makes the files, so a repeated task writes nothing twice and any store will do."""
    text = F.to_json("v", {"pretty": "true"})
    rows.select(F.col(name).alias("name"), text.alias("value"), F.substring(F.lower(name), 1, 2).alias("part")).write.mode("overwrite").partitionBy("part").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines, one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def stored(artifacts: DataFrame, folder: str) -> DataFrame:
    """Puts artifacts(name, content binary) into a store, by the digest of their content, and returns name, url.

    A content that is there already, or that several names have, is stored once. folder: any path that Spark writes to."""
    spark = artifacts.sparkSession
    keyed = artifacts.select("name", F.sha2("content", 256).alias("digest"), "content")
    new = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    if any(not n.startswith(("_", ".")) for n in shared.names(spark, folder)):
        new = new.join(spark.read.parquet(folder).select("digest"), "digest", "left_anti")
    new.write.mode("append").parquet(folder)
    return keyed.select("name", F.concat(F.lit(folder.rstrip("/") + "#"), F.col("digest")).alias("url"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts TIMESTAMP, canonical_name STRING, driver STRING, store_url STRING, success BOOLEAN, error STRING").json(path)


def sniff_specs(texts: DataFrame) -> DataFrame:
    """spec, backend, docs, n_invariants of specification sources (_path, value) by their text alone: header keys, and lines that name a function or open a table row."""
    head = lambda key: F.regexp_extract("value", rf"(?m)^{key}:\s*[\"']?([^\"'\n#]+)", 1)
    rows = F.regexp_count("value", F.lit(r"(?m)^\s+function:")) + F.regexp_count("value", F.lit(r"(?m)^\s+- \["))
    return texts.select("_path", F.trim(head("spec")).alias("spec"), F.trim(head("backend")).alias("backend"), F.trim(head("docs")).alias("docs"), rows.alias("n_invariants"))

"""Queries of sources, sinks and streams: texts, files and trees are written from the driver's tables, read back, and held against SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill import shared
from lodemill.functions import packages
from lodemill.operators import audit, merge, rank, validate
from lodemill.plans.base import query, table
from lodemill.sources import files, generators, recipes, records, seeds, specs
from lodemill.streaming import incremental


def text(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def as_text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tree(rows: DataFrame, name: str) -> str:
    """A tree of files(filename, content) in the shared folder."""
    path = shared.new_path(rows.sparkSession, name)
    files.write_files(rows, path)
    return path


def supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, content: suppliers as JSON records, three of them a name, in two roots; one in ten has no identity, one in nine is no JSON."""
    k = F.col("s_suppkey")
    body = text(
        '{"schema_version": "0.2", ', F.when(k % 10 == 0, "").otherwise(text('"identity": {"canonical_name": "n', as_text(F.floor(k / 3)), '", "ecosystem": "', F.when(k % 2 == 0, "ports").otherwise("nix"), '", "version": "1.', as_text(k % 4), '"}, ')),
        '"descriptive": {"summary": "s', as_text(k), '", "maintainers": ["m', as_text(k), '", "all"], "license": ["L', as_text(k % 2), '"]}, "sources": [], "provenance": {"confidence": ', as_text((k * 37 % 100) / 100), "}}",
    )
    name = text(F.when(k % 2 == 0, "a/").otherwise("b/x/"), F.lpad(as_text(k), 8, "0"), ".json")
    rows = table(spark, sf_dir, "supplier").select(name.alias("filename"), F.when(k % 9 == 0, "no json").otherwise(body).alias("content"))
    others = spark.createDataFrame([("a/manifest.json", "{}"), ("a/reports/r.json", '{"identity": {"canonical_name": "report"}}'), ("b/readme.txt", "{}")], "filename string, content string")
    return rows.unionByName(others)


SUPPLIERS = "SELECT s_suppkey AS k, 'n' || (s_suppkey // 3) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'ports' ELSE 'nix' END AS eco, '1.' || (s_suppkey % 4) AS version, (s_suppkey * 37 % 100) / 100 AS trust FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 9 <> 0"


def supplier_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(supplier_documents(spark, sf_dir), "snapshot")
    return records.snapshot(spark, [f"{root}/a", f"{root}/b"])


@query("snapshot_scan", f"SELECT lpad(k::VARCHAR, 8, '0') || '.json' AS file, name, eco, version, trust FROM ({SUPPLIERS})")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files one a record, in two roots; what is no record, a manifest or a report is left out."""
    snap = supplier_snapshot(spark, sf_dir)
    return snap.select(F.substring_index("_path", "/", -1).alias("file"), F.col("_name").alias("name"), F.col("identity.ecosystem").alias("eco"), F.col("identity.version").alias("version"), F.col("provenance.confidence").alias("trust"))


@query("snapshot_bulk_merge", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY trust DESC, k % 2, k) AS place FROM ({SUPPLIERS}))
SELECT name, 's' || max(k) FILTER (place = 1) AS summary, string_agg(DISTINCT eco, ',' ORDER BY eco) AS merged_from,
  'm' || max(k) FILTER (place = 1) || ',all' || coalesce(string_agg(',m' || k, '' ORDER BY k % 2, k) FILTER (place > 1), '') AS maintainers FROM r GROUP BY 1""")
def snapshot_bulk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging records as a snapshot's files give them: of equal trust the first by path."""
    found = merge.bulk_merged(supplier_snapshot(spark, sf_dir), F.col("_name"))
    return found.select("name", "descriptive.summary", F.array_join("merged_from", ",").alias("merged_from"), F.array_join("descriptive.maintainers", ",").alias("maintainers"))


@query("snapshot_extraction", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY trust DESC, k % 2, k) AS place FROM ({SUPPLIERS})),
e AS (SELECT name, eco, max_by(version, k) AS version, max_by(k % 2, k) AS lic FROM r GROUP BY 1, 2)
SELECT name, 's' || max(k) FILTER (place = 1) AS summary, string_agg('m' || k, ',' ORDER BY 'm' || k) AS maintainers, (SELECT count(DISTINCT version) <= 1 FROM e WHERE e.name = r.name) AS version_agreement,
  (SELECT count(DISTINCT lic) <= 1 FROM e WHERE e.name = r.name) AS license_agreement FROM r GROUP BY 1""")
def snapshot_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.extracted(supplier_snapshot(spark, sf_dir))
    names = F.array_join(F.filter("maintainers", lambda m: m != "all"), ",")
    return found.select("name", "summary", names.alias("maintainers"), "version_agreement", "license_agreement")


@query("snapshot_stubs", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY trust DESC, k % 2, k) AS place FROM ({SUPPLIERS}))
SELECT name, max(version) FILTER (place = 1) AS version, 'm' || max(k) FILTER (place = 1) || ',all' || coalesce(string_agg(',m' || k, '' ORDER BY place) FILTER (place > 1), '') AS maintainers, TRUE AS stub FROM r GROUP BY 1""")
def snapshot_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.stubs(supplier_snapshot(spark, sf_dir), F.col("_name")).select("name", "identity.version", F.array_join("descriptive.maintainers", ",").alias("maintainers"), "stub")


@query("nix_tree_records", """
WITH r AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0)
SELECT 'pkg' || k AS name, CASE WHEN m = 0 THEN 'unknown' ELSE '2.' || m END AS version, CASE m WHEN 1 THEN 'cmake' WHEN 2 THEN 'meson' ELSE 'autotools' END AS build_system, CASE WHEN k % 3 = 0 THEN 'MIT,Zlib' ELSE '' END AS licenses,
  'pkg-config,perl' AS build_deps, CASE WHEN m = 3 THEN './a.patch' ELSE '' END AS patches, m <> 0 AND m <> 3 AS clean FROM r""")
def nix_tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes in a tree of folders; one in seven lies where no packages are, one in five is no derivation."""
    k = F.col("s_suppkey")
    value = text(
        "{ stdenv }:\n", F.when(k % 5 == 0, "").otherwise("stdenv.mkDerivation {\n"), '  pname = "pkg', as_text(k), '";\n', F.when(k % 4 == 0, "").otherwise(text('  version = "2.', as_text(k % 4), '";\n')),
        "  nativeBuildInputs = [ pkg-config # not this\n    buildPackages.perl ", F.when(k % 4 == 1, "cmake ").when(k % 4 == 2, "meson ").otherwise(""), "];\n", F.when(k % 4 == 3, "  patches = [ ./a.patch ];\n").otherwise(""),
        '  meta = { description = "d"; homepage = "https://h"; ', F.when(k % 3 == 0, "license = with lib; [ licenses.mit licenses.zlib ]; ").otherwise(""), "};\n}\n",
    )
    folder = F.when(k % 7 == 0, "nixos/modules").otherwise("pkgs/tools")
    root = tree(table(spark, sf_dir, "supplier").select(text(folder, "/p", as_text(k), "/default.nix").alias("filename"), value.alias("content")), "nix")
    found = recipes.nix_recipes(recipes.nix_tree(spark, root))
    real = F.filter("build_deps", lambda d: ~d.isin("cmake", "meson"))
    system = F.when(F.col("build_system") == "perl", "autotools").otherwise(F.col("build_system"))
    return found.select("name", "version", system.alias("build_system"), F.array_join("licenses", ",").alias("licenses"), F.array_join(real, ",").alias("build_deps"), F.array_join("patches", ",").alias("patches"), (F.size("warnings") == 0).alias("clean"))


@query("slave_ports", """
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'own' || p_partkey ELSE 'part' || (p_partkey - p_partkey % 3) END AS name, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN '1.' || (p_partkey - p_partkey % 3) ELSE 'unknown' END AS version FROM part
WHERE p_partkey >= 3""")
def slave_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports two in three of which take what they lack from a master next to them; every other one of them replaces its version by nothing."""
    k = F.col("p_partkey")
    master = k - k % 3
    own = text("PORTNAME=\town", as_text(k), "\nPORTVERSION=\t1.", as_text(k), "\n")
    slave = text("MASTERDIR=\t${.CURDIR}/../p", as_text(master), "\nPORTNAME=\tpart", as_text(master), "\n", F.when(k % 2 == 0, "").otherwise("PORTVERSION=\n"))
    ports = table(spark, sf_dir, "part").select(text("cat/p", as_text(k)).alias("dir"), recipes.make_variables(F.when(k % 3 == 0, own).otherwise(slave)).alias("vars"), k.alias("k"))
    found = recipes.port_recipes(recipes.inherited(ports).where("k >= 3"))
    return found.select(F.regexp_extract("dir", "p([0-9]+)$", 1).cast("long").alias("k"), "name", "version")


@query("nix_evaluated", """
SELECT 'a' || c_custkey AS attr, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey ELSE 'a' || c_custkey END AS name, CASE WHEN c_nationkey % 3 = 0 THEN 'unknown' ELSE '1.' || c_nationkey END AS version,
  'L' || c_nationkey AS licenses, c_nationkey % 3 = 0 AS no_version FROM customer WHERE c_custkey % 11 <> 0""")
def nix_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated attributes in batches of one JSON object a nation, null for one customer in eleven."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    one = text('"a', as_text(k), '": ', F.when(k % 11 == 0, "null").otherwise(text("{", F.when(k % 2 == 0, text('"pname": "p', as_text(k), '", ')).otherwise(""), F.when(n % 3 == 0, "").otherwise(text('"version": "1.', as_text(n), '", ')), '"license": ["L', as_text(n), '", ""]}')))
    batches = table(spark, sf_dir, "customer").groupBy(n, (k % 50).alias("b")).agg(F.array_join(F.collect_list(one), ", ").alias("all"))
    root = tree(batches.select(text(as_text("c_nationkey"), "-", as_text("b"), ".json").alias("filename"), text("{", F.col("all"), "}").alias("content")), "evaluated")
    found = recipes.nix_evaluated(records.evaluated(spark, root))
    return found.select("attr", "name", "version", F.array_join("licenses", ",").alias("licenses"), (F.size("warnings") == 2).alias("no_version"))


@query("pypi_documents", """
SELECT c_custkey AS k, 'pkg-' || c_custkey AS name, '1.' || c_nationkey AS version, CASE WHEN c_custkey % 3 = 0 THEN 'dep.a,dep-b' ELSE 'dep.a' END AS runtime_deps, CASE WHEN c_custkey % 2 = 0 THEN 'u-sdist' ELSE 'u-wheel' END AS source_url,
  CASE WHEN c_custkey % 4 = 0 THEN 'https://h' ELSE 'https://github.com/o/r' || c_custkey END AS homepage FROM customer""")
def pypi_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = text(
        '{"info": {"name": "Pkg_', as_text(k), '", "version": "1.', as_text("c_nationkey"), '", "home_page": "', F.when(k % 4 == 0, "https://h").otherwise(""), '", "project_urls": {"Source": "https://github.com/o/r', as_text(k), '"}, "requires_dist": ["Dep.A>=1; python_version > \\"3\\"", "x; extra == \\"test\\""',
        F.when(k % 3 == 0, ', "dep_b (>2)"').otherwise(""), ']}, "urls": [{"packagetype": "bdist_wheel", "url": "u-wheel"}', F.when(k % 2 == 0, ', {"packagetype": "sdist", "url": "u-sdist"}').otherwise(""), "]}",
    )
    found = recipes.pypi_documents(table(spark, sf_dir, "customer").select("c_custkey", F.parse_json(v).alias("v")))
    return found.select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("k"), "name", "version", F.array_join("runtime_deps", ",").alias("runtime_deps"), "source_url", "homepage")


@query("crate_documents", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '2.0' ELSE '1.0' END AS version, CASE WHEN c_custkey % 2 = 0 THEN FALSE ELSE TRUE END AS permissive, CASE WHEN c_custkey % 3 = 0 THEN 'a-b,opt' ELSE 'a-b' END AS runtime_deps, 'cc' AS build_deps, 't' AS test_deps FROM customer""")
def crate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = text(
        '{"crate": {"id": "c', as_text(k), '"}, "versions": [{"num": "2.0", "yanked": ', F.when(k % 2 == 0, "false").otherwise("true"), ', "license": "GPL-3.0"}, {"num": "1.0", "yanked": false, "license": "MIT OR Apache-2.0"}], "dependencies": [{"crate_id": "a_b", "kind": "normal", "optional": false}, ',
        '{"crate_id": "opt", "kind": "normal", "optional": ', F.when(k % 3 == 0, "false").otherwise("true"), '}, {"crate_id": "cc", "kind": "build", "optional": true}, {"crate_id": "t", "kind": "dev", "optional": false}]}',
    )
    found = recipes.cargo_documents(table(spark, sf_dir, "customer").select(F.parse_json(v).alias("v")))
    joined = [F.array_join(c, ",").alias(c) for c in ("runtime_deps", "build_deps", "test_deps")]
    return found.select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("k"), "version", "permissive", *joined)


def supplier_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as YAML specifications, read into documents."""
    k, n = as_text("s_suppkey"), as_text("s_nationkey")
    value = text(
        "spec: s", k, "\nversion: \">=1.", n, "\"\nbackend: ", F.when(F.col("s_suppkey") % 2 == 0, text("python_cleanroom(m", k, ")")).otherwise(text("cli(tool", k, ")")), "\ndocs: https://d/", k,
        "\nconstants:\n  levels: {BEST: ", n, ", NONE: {value: 0, description: d}}\n  names: [{name: N, value: v", k, "}]\ntypes:\n  T", k, ": {fields: [{name: x, type: int}]}\nwire_formats: {frame: {magic: \"", n, "\"}}\n",
        "functions:\n  f: {params: {a: {type: int}}, returns: int}\nerror_model: {semantics: s", n, ", codes: {E1: {value: -", n, "}, E2: {}}}\n",
        "invariant s.one: {call: \"m.f(", n, ", b'ab')\", eq: ", k, ", category: c", n, "}\ninvariant s.two: {kind: constant_eq, name: BEST, expected_value: ", n, "}\n",
        "table cases:\n  kind: call_eq\n  id_prefix: t\n  columns: [id, args, expected]\n  describe: \"case {id}\"\n  rows:\n    - [r", k, ", [1], 2]\n    - [last, [2], 3, {category: own}]\n",
    )
    return specs.parsed(table(spark, sf_dir, "supplier").select(text("f", k).alias("_path"), value.alias("value")))


@query("compiled_specs", """
SELECT 's' || s_suppkey AS spec, '>=1.' || s_nationkey AS versions, CASE WHEN s_suppkey % 2 = 0 THEN 'python_cleanroom' ELSE 'cli' END AS backend, '{"T' || s_suppkey || '":{"fields":[{"name":"x","type":"int"}]}}' AS types, '{"frame":{"magic":"' || s_nationkey || '"}}' AS wire_formats,
  '[{"name":"E1","value":' || -s_nationkey || '},{"name":"E2"}]' AS error_codes, 's' || s_nationkey AS semantics, 4::BIGINT AS n_invariants, 0::BIGINT AS n_issues FROM supplier""")
def compiled_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole compiled specifications with types, wire formats and all of each error code, which validation finds nothing wrong with."""
    whole = specs.compiled(supplier_specs(spark, sf_dir))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    issues = F.size(F.filter(validate.spec_issues("v"), lambda i: i["level"] == "ERROR")).cast("long")
    return whole.select(
        "spec", get("$.identity.spec_for_versions").alias("versions"), get("$.library.backend").alias("backend"), F.to_json(get("$.types", "variant")).alias("types"), F.to_json(get("$.wire_formats", "variant")).alias("wire_formats"),
        F.to_json(get("$.error_model.error_codes", "variant")).alias("error_codes"), get("$.error_model.return_code_semantics").alias("semantics"), F.size(get("$.invariants", "array<variant>")).cast("long").alias("n_invariants"), issues.alias("n_issues"),
    )


@query("spec_constants", """
SELECT 's' || s_suppkey AS spec, x.grp AS "group", x.name, CASE x.name WHEN 'BEST' THEN s_nationkey::VARCHAR WHEN 'NONE' THEN '0' ELSE 'v' || s_suppkey END AS value FROM supplier, (VALUES ('levels', 'BEST'), ('levels', 'NONE'), ('names', 'N')) x(grp, name)""")
def spec_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.constants(supplier_specs(spark, sf_dir)).select("spec", "group", "name", "value")


@query("spec_invariants", """
SELECT 's' || s_suppkey AS spec, x.id AS id, CASE x.i WHEN 1 THEN 'python_call_eq' WHEN 2 THEN 'constant_eq' ELSE 'call_eq' END AS kind, CASE x.i WHEN 1 THEN 'python_call_eq: s.one' WHEN 2 THEN 'constant_eq: s.two' WHEN 3 THEN 'case r' || s_suppkey ELSE 'case last' END AS description,
  CASE x.i WHEN 1 THEN 'c' || s_nationkey ELSE 'general' END AS category, CASE x.i WHEN 1 THEN '[' || s_nationkey || ',{"type":"bytes_hex","value":"6162"}]' WHEN 2 THEN 'none' WHEN 3 THEN '[1]' ELSE '[2]' END AS args
FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM supplier) s, LATERAL (SELECT s.i AS i, CASE s.i WHEN 1 THEN 's.one' WHEN 2 THEN 's.two' WHEN 3 THEN 's' || s.s_suppkey || '.t.r' || s.s_suppkey ELSE 's' || s.s_suppkey || '.t.last' END AS id) x""")
def spec_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single invariants with calls and constants, and those of tables with cells that replace fields of the body (and no part of the head)."""
    every = specs.all_invariants(supplier_specs(spark, sf_dir)).where("problem IS NULL")
    args = F.coalesce(F.to_json(F.try_variant_get("fields", "$.args", "variant")), F.lit("none"))
    return every.select("spec", "id", "kind", "description", "category", args.alias("args"))


@query("spec_lint", """
SELECT 'p' || p_partkey AS spec, CASE WHEN p_partkey % 3 = 0 THEN 'ERROR' ELSE 'WARN' END AS level FROM part WHERE (p_partkey % 3 = 0 AND p_partkey % 5 <> 0) OR p_partkey % 3 = 1""")
def spec_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, "rust_module(x)\n").when(k % 3 == 1, 'python_cleanroom(x)\nnotes:\n  - "Expose dumps: json.dumps"\n').otherwise("python_cleanroom(y)\n")
    sources = table(spark, sf_dir, "part").select(text("spec: p", as_text(k), "\nbackend: ", body).alias("value"))
    known = table(spark, sf_dir, "part").where(k % 5 == 0).select(text("p", as_text(k)).alias("spec"))
    return validate.lint(sources, known).select("spec", "level")


@query("spec_sniff", "SELECT 'p' || p_partkey AS spec, 'cli(' || p_size || ')' AS backend, p_size + 1 AS n_invariants FROM part")
def spec_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and numbers of invariants by a text alone."""
    rows = F.array_join(F.array_repeat(F.lit("    - [a, 1]\n"), F.col("p_size")), "")
    value = text("spec: p", as_text("p_partkey"), "\nbackend: cli(", as_text("p_size"), ")  # tool\ntable t:\n  rows:\n", rows, "invariant x:\n  function: f\n")
    return records.sniff_specs(table(spark, sf_dir, "part").select(F.lit("f").alias("_path"), value.alias("value"))).select("spec", "backend", "n_invariants")


@query("file_checks", """
SELECT 'f' || c_custkey AS _path, CASE WHEN c_custkey % 4 < 2 THEN 1 WHEN c_custkey % 4 = 2 THEN 23 ELSE 0 END AS n_errors, c_custkey % 4 = 3 AS valid FROM customer""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no JSON, a list, an empty record and a good record."""
    good = (
        '{"schema_version": "1", "identity": {"canonical_name": "n", "canonical_id": "i", "version": "1", "ecosystem": "nixpkgs", "ecosystem_id": "e"}, "descriptive": {}, "sources": [], "dependencies": {"build": [], "host": [], "runtime": [], "test": []}, '
        '"build": {}, "features": {}, "platforms": {}, "conflicts": [], "patches": [], "tests": {}, "provenance": {"confidence": 1}, "extensions": {}}'
    )
    value = F.get(F.array(*map(F.lit, ("{no", "[1]", "{}", good))), (F.col("c_custkey") % 4).cast("int"))
    found = validate.file_validity(table(spark, sf_dir, "customer").select(text("f", as_text("c_custkey")).alias("_path"), value.alias("value")))
    return found.select("_path", F.col("n_errors").cast("int").alias("n_errors"), "valid")


@query("import_policy", """
WITH i AS (SELECT DISTINCT 'm' || (l_suppkey % 5) AS package, ['json', '_hashlib', 'own_a', 'own_b', 'numpy', 'hashlib', '__future__'][1 + l_partkey % 7] AS root FROM lineitem),
b AS (SELECT *, CASE package WHEN 'm0' THEN 'hashlib.sha' WHEN 'm1' THEN 'json' WHEN 'm2' THEN 'hashlib' ELSE 'other' END AS blocks FROM i)
SELECT package, root, CASE WHEN root = split_part(blocks, '.', 1) THEN 'blocked' WHEN root = '_hashlib' AND split_part(blocks, '.', 1) = 'hashlib' THEN 'backdoor' WHEN root = 'own_b' THEN 'not verified' WHEN root = 'own_a' THEN NULL ELSE 'not standard' END AS reason
FROM b WHERE root <> '__future__' AND root <> 'own_a' AND (root = split_part(blocks, '.', 1) OR root = 'own_b' OR root IN ('_hashlib', 'numpy'))""")
def import_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as imports of five packages."""
    roots = F.array(*map(F.lit, ("json", "_hashlib", "own_a", "own_b", "numpy", "hashlib", "__future__")))
    package = text("m", as_text(F.col("l_suppkey") % 5))
    imports = table(spark, sf_dir, "lineitem").select(package.alias("package"), F.get(roots, (F.col("l_partkey") % 7).cast("int")).alias("root"))
    blocks = F.when(F.col("package") == "m0", "hashlib.sha").when(F.col("package") == "m1", "json").when(F.col("package") == "m2", "hashlib").otherwise("other")
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "root string")
    return validate.import_policy(imports, imports.select("package", blocks.alias("blocks")), validate.backdoors(spark), one("json", "hashlib"), one("own_a"), "own_")


@query("answer_files", """
SELECT o_orderkey AS k, 'src/a' || o_custkey || '.py' AS name, CASE WHEN o_orderkey % 3 = 2 THEN '# src/a' || o_custkey || '.py' || chr(10) || 'y' ELSE 'x = ' || o_orderkey END AS content FROM orders WHERE o_orderkey % 4 > 0 OR o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, 'b.txt', 'b' FROM orders WHERE o_orderkey % 3 = 0""")
def answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in answers: marked blocks, a fence that names a file, a first comment that does, and answers without any."""
    k, name = as_text("o_orderkey"), text("src/a", as_text("o_custkey"), ".py")
    kind = F.col("o_orderkey") % 3
    marked = text('Here:\n<file name="', name, '">\n<content>\nold\n</content>\n</file>\n<file name="', name, '"><content>\nx = ', k, '\n</content></file>\n<file name="b.txt"><content>b</content></file>')
    fenced = text("```python ", name, "\nx = ", k, "\n```\nand ```\nno name\n```")
    comment = F.when(F.col("o_orderkey") % 4 > 0, text("```\n# ", name, "\ny\n```")).otherwise("nothing")
    answer = F.when(kind == 0, marked).when(kind == 1, fenced).otherwise(comment)
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(generators.answer_files(answer)).alias("name", "content"))
    return found


@query("invariant_lines", """
SELECT e.event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id || '  [' || event_type || ']' ELSE 'e' || event_id || '  →  ''' || substr(props, 1, 10) || '''  [' || event_type || ']' END AS line FROM events e""")
def invariant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", generators.invariant_line(text("e", as_text("event_id")), F.col("event_type"), expected, 10).alias("line"))


@query("audit_report", """
WITH r AS (SELECT s_suppkey AS k, 's' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'odd' ELSE 'infeasible' END AS status, s_suppkey % 7 AS p, s_suppkey % 3 AS f FROM supplier),
a AS (SELECT count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'partial') AS part, count(*) FILTER (status = 'odd') AS bad, count(*) FILTER (status = 'infeasible') AS no, sum(p + f)::BIGINT AS t, sum(p)::BIGINT AS p, sum(f)::BIGINT AS f FROM r),
h AS (SELECT unnest(range(24)) AS n, unnest([repeat('=', 70), 'AUDIT', 'Generated: today', 'Model:     m' || (SELECT min(name) FILTER (k % 2 = 1) FROM r), repeat('=', 70), '', 'SUMMARY', repeat('-', 40), '  Total specs:          ' || n, '  Succeeded:            ' || ok, '  Partial:              ' || part,
  '  Failed:               ' || bad, '  Build failed:         0', '  Infeasible:           ' || no, '  Total invariants:     ' || t, '  Passing invariants:   ' || p, '  Failing invariants:   ' || f, '  Synthesizability:     ' || printf('%.1f%%', round(ok / n, 4) * 100), '', 'PER-SPEC RESULTS', repeat('-', 70),
  'Spec                           Lang         Status          Pass  Fail Iters', repeat('-', 70), '']) AS value FROM a)
SELECT 0 AS section, '' AS key, n::INT AS at, value FROM h WHERE n < 23
UNION ALL SELECT 1, name, 0, rpad(name, 30, ' ') || ' python       ' || rpad(status, 14, ' ') || ' ' || lpad(p::VARCHAR, 5, ' ') || ' ' || lpad(f::VARCHAR, 5, ' ') || '     1' FROM r
UNION ALL SELECT 2, '', 0, '' UNION ALL SELECT 2, '', 1, 'FAILED INVARIANT DETAILS' UNION ALL SELECT 2, '', 2, repeat('-', 70) UNION ALL SELECT 4, '', 0, ''
UNION ALL SELECT 3, name, 0, '  ' || name || ':' FROM r WHERE f > 0 UNION ALL SELECT 3, name, i + 1, '    - i' || i || ': ' || repeat('x', 80) FROM r, unnest(range(3)) AS g(i) WHERE i < f""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an audit of suppliers as results, written as text and read again by their places."""
    k = F.col("s_suppkey")
    ids = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < k % 3)
    failed = F.map_from_entries(F.transform(ids, lambda i: F.struct(text("i", i.cast("string")), F.lit("x" * 90))))
    results = table(spark, sf_dir, "supplier").select(
        text("s", as_text(k)).alias("canonical_name"), F.lit("python").alias("backend_lang"), F.get(F.array(*map(F.lit, ("success", "partial", "odd", "infeasible"))), (k % 4).cast("int")).alias("status"), F.when(k % 2 == 1, text("ms", as_text(k))).otherwise("").alias("model"),
        F.lit(1).alias("iterations"), (k % 7).alias("pass_count"), (k % 3).alias("fail_count"), (k % 7 + k % 3).alias("total_invariants"), failed.alias("failed"),
    )
    lines = shared.written(generators.audit_lines(results, "AUDIT", "today"), "lines")
    path = shared.new_path(spark, "report")
    generators.text_file(lines, path, ["section", "key", "at"])
    if spark.read.text(path).count() != lines.count():
        raise AssertionError("lines are lost")
    return lines


@query("build_logs", """
SELECT count(DISTINCT o_custkey) AS specs, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS errors, min('c' || o_custkey) FILTER (o_orderstatus <> 'F') AS first_failed FROM orders""")
def build_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a log in two goes, read back and summed up."""
    path = shared.new_path(spark, "log")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), text("c", as_text("o_custkey")).alias("canonical_name"), F.lit("d").alias("driver"), F.lit("u").alias("store_url"), (F.col("o_orderstatus") == "F").alias("success"), F.lit("").alias("error"), "o_orderkey")
    for part in (0, 1):
        records.append_log(rows.where(F.col("o_orderkey") % 2 == part).drop("o_orderkey"), path)
    return audit.build_summary(records.read_log(spark, path))


@query("artifact_store", """
SELECT p_partkey, sha256(p_type) AS digest, (SELECT count(DISTINCT p_type) FROM part) AS n_stored FROM part""")
def artifact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored once by their digest, though many parts have them and half of them come again."""
    path = shared.new_path(spark, "store")
    parts = table(spark, sf_dir, "part").select(as_text("p_partkey").alias("name"), F.col("p_type").cast("binary").alias("content"))
    records.stored(parts.where("CAST(name AS BIGINT) % 2 = 0"), path)
    urls = records.stored(parts, path)
    n = spark.read.parquet(path).count()
    return urls.select(F.col("name").cast("long").alias("p_partkey"), F.substring_index("url", "#", -1).alias("digest"), F.lit(n).cast("long").alias("n_stored"))


@query("seed_lists", "SELECT DISTINCT lower(c_mktsegment) || '-' || c_nationkey AS name FROM customer UNION SELECT 'supplier-' || s_nationkey FROM supplier")
def seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written to a list with comments, read back, and those of another list that it lacks."""
    path = shared.new_path(spark, "names")
    lines = table(spark, sf_dir, "customer").select(text(F.lower("c_mktsegment"), "-", as_text("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, "  # noted").otherwise("")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# none",), ("  ",)], "value string")).write.text(path)
    more = table(spark, sf_dir, "supplier").select(text("supplier-", as_text("s_nationkey")).alias("name"))
    return seeds.with_more(seeds.listed_names(records.names_file(spark, path), "name"), more.distinct())


@query("top_candidates", """
SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS place FROM (SELECT o_custkey::VARCHAR AS name, count(*) AS score FROM orders GROUP BY 1) ORDER BY score DESC, name LIMIT 25""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 customers with most orders, names breaking ties, with their places."""
    top = rank.ranked(table(spark, sf_dir, "orders").groupBy(as_text("o_custkey").alias("name")).agg(F.count("*").alias("score")), top=25)
    held = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "name"))).alias("all"))
    return held.select(F.posexplode("all").alias("at", "x")).select("x.name", (-F.col("x.minus")).alias("score"), (F.col("at") + 1).cast("long").alias("place"))


@query("take_ranked", """
WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, l_linestatus FROM lineitem), d AS (SELECT l_partkey AS dep, count(DISTINCT l_orderkey) AS refs FROM r GROUP BY 1), k AS (SELECT p_partkey FROM part WHERE p_size > 20)
SELECT dep, refs AS ref_count FROM d WHERE dep IN (SELECT p_partkey FROM k) AND refs >= 3 ORDER BY refs DESC, dep LIMIT 30""")
def take_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most needed parts among the large ones."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.lit("e").alias("ecosystem"), F.col("l_partkey").alias("dep"))
    known = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("name"))
    return rank.take_ranked(rank.fan_in(edges, known), ["e"], 3, 30).select("dep", "ref_count")


@query("known_ecosystems", "SELECT o_custkey AS name, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS known_ecosystems FROM orders GROUP BY 1")
def known_ecosystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.known_ecosystems(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("ecosystem")))


@query("next_wave", """
WITH w AS (SELECT o_custkey % 20 AS ordinal, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1) SELECT ordinal, total, done FROM w WHERE done < total ORDER BY ordinal LIMIT 1""")
def next_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("wave"), F.col("o_orderkey").alias("spec"))
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec"), (F.col("o_orderstatus") == "F").alias("done"), F.lit(1).alias("n_pass"), F.lit(0).alias("n_fail"))
    found = audit.wave_status(matched, state).withColumnRenamed("wave", "ordinal")
    return audit.next_wave(found).select("ordinal", "total", "done")


@query("wave_plan", """
SELECT 'w' || w AS wave, count(*) AS n FROM (SELECT p_partkey, unnest([p_partkey % 7, 100 + p_size % 3]) AS w FROM part) WHERE w < 3 OR w >= 100 GROUP BY 1""")
def wave_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves that list their specifications (one of them as long as a seventh of all), and waves by backend."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    items = parts.select(text("p", as_text(k)).alias("spec"), text("b", as_text(F.col("p_size") % 3)).alias("backend"), F.lit("l").alias("backend_lang"))
    listed = parts.where(k % 7 < 3).groupBy((k % 7).alias("w")).agg(F.collect_list(text("p", as_text(k))).alias("names")).select(text("w", as_text("w")).alias("wave"), "names", F.lit(None).cast("string").alias("wave_backend"))
    by_kind = spark.createDataFrame([(f"w10{i}", None, f"b{i}") for i in range(3)], "wave string, names array<string>, wave_backend string")
    waves = listed.unionByName(by_kind).withColumns({"wave_lang": F.lit(None).cast("string"), "exclude": F.lit(None).cast("array<string>"), "pattern": F.lit(None).cast("string")})
    return audit.in_waves(items, waves, audit.wave_match()).groupBy("wave").agg(F.count("*").alias("n"))


@query("allowed_licences", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://github.com/o/r' || p_partkey WHEN 1 THEN 'https://github.com/a/b' ELSE '' END AS repository FROM part""")
def allowed_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source repositories by the priority of a package's links."""
    k = F.col("p_partkey")
    links = F.when(k % 4 == 0, F.create_map(F.lit("Source"), text("https://github.com/o/r", as_text(k)), F.lit("Docs"), F.lit("https://d"))).otherwise(F.create_map(F.lit("Docs"), F.lit("https://d")))
    found = packages.source_repository(links, F.when(k % 4 == 1, "https://github.com/a/b").otherwise("https://h"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(found, F.lit("")).alias("repository"))


def event_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events in four batches, by number."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return [rows.where(F.col("event_id") % 4 == i) for i in range(4)]


@query("stream_state", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event, kept over four batches that come in a stream of files."""
    source, state, checkpoint = (shared.new_path(spark, n) for n in ("events", "state", "checkpoint"))
    keep = incremental.keeping_state(spark, state, "user_id", "event_id")
    for rows in event_batches(spark, sf_dir):
        rows.write.mode("append").json(source)
        incremental.watched(spark, source, "event_id long, user_id long, event_type string", keep, checkpoint, once=True).awaitTermination()
    return incremental.state(spark, state, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("stream_runs", """
WITH r AS (SELECT 'r' || (user_id % 3) AS run, event_type || '-' || (event_id % 11) AS id, bool_and(event_id % 13 <> 0) AS passed FROM events GROUP BY 1, 2),
b AS (SELECT event_type || '-' || n AS id, n % 2 = 0 AS passed FROM (SELECT DISTINCT event_type FROM events), unnest(range(12)) AS x(n)),
j AS (SELECT coalesce(r.run, k.run) AS run, coalesce(r.id, k.id) AS id, k.passed AS was, r.passed AS now FROM r FULL JOIN (SELECT run, b.* FROM b, (SELECT DISTINCT run FROM r)) k ON k.id = r.id AND k.run = r.run)
SELECT run, id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was AND NOT now THEN 'regression' ELSE 'fix' END AS change FROM j WHERE was IS NULL OR now IS NULL OR was <> now""")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs whose results come in four batches, each against a baseline once all of it is there."""
    folder = shared.new_path(spark, "runs")
    events = table(spark, sf_dir, "events")
    name = text(F.col("event_type"), "-", as_text(F.col("event_id") % 11))
    results = events.groupBy(text("r", as_text(F.col("user_id") % 3)).alias("run"), name.alias("id")).agg(F.bool_and(F.col("event_id") % 13 != 0).alias("passed"))
    results = shared.written(results, "results")
    sizes = results.groupBy("run").agg(F.count("*").alias("n_results"))
    rows = shared.written(results.join(sizes, "run").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4))), "rows")
    expected = events.select("event_type").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n"), "event_type").select(text(F.col("event_type"), "-", as_text("n")).alias("id"), (F.col("n") % 2 == 0).alias("passed"))
    each = incremental.against_baseline(expected, ["id"], folder)
    for batch in range(4):
        each(rows.where(F.col("part") == batch).drop("part"), batch)
    return spark.read.parquet(f"{folder}/diff").select("run", "id", "change")


@query("stream_reruns", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'second' ELSE 'first' END AS version FROM supplier")
def stream_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which every other one is rewritten: only these run again, and the state holds their new rows."""
    source, kept, state = (shared.new_path(spark, n) for n in ("in", "listing", "state"))
    keep = incremental.keeping_state(spark, state, "s_suppkey", "at")
    k = F.col("s_suppkey")
    for at, version in enumerate(("first", "second")):
        rows = table(spark, sf_dir, "supplier").where(k % 2 == 0) if at else table(spark, sf_dir, "supplier")
        line = text('{"s_suppkey": ', as_text(k), f', "at": {at}, "version": "{version}"' + "}\n")
        files.write_files(rows.select(text(as_text(k % 40), "/", as_text(k), ".json").alias("filename"), line.alias("content")), source)
        n = incremental.rerun(spark, source, "s_suppkey long, at int, version string", lambda found, batch: keep(found.drop("_path"), batch), kept)
        if n != rows.count():
            raise AssertionError(f"{n} files ran instead of {rows.count()}")
    return incremental.state(spark, state, "s_suppkey", "at").select("s_suppkey", "version")


@query("stream_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log by a stream of files, each once, also when the stream is started again."""
    source, log, checkpoint = (shared.new_path(spark, n) for n in ("events", "log", "checkpoint"))
    for rows in event_batches(spark, sf_dir)[::-1]:
        rows.write.mode("append").json(source)
        incremental.appended(spark.readStream.schema(rows.schema).json(source), log, checkpoint, once=True).awaitTermination()
    return spark.read.schema("event_type string").json(log).groupBy("event_type").agg(F.count("*").alias("n"))

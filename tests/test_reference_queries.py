"""Every query against its SQL over the smallest tables, and the parsers over small literal inputs."""

import base64
import hashlib
import hmac
import json
import math
import posixpath
import statistics
import textwrap
import urllib.parse
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodemill.functions import packages, scalars, sequences, texts
from lodemill.operators import audit, closure, evaluate, invariants, merge, rank, scan, sql_cases, validate
from lodemill.plans import registry
from lodemill.sources import files, generators, imports, recipes, records, seeds, specs
from lodemill.streaming import incremental

DATA = Path("/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(registry.QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_licences(spark):
    cases = {"MIT": True, "GPL-3.0": False, "GPL-2.0 OR MIT": True, "MIT AND GPL-2.0": False, "Custom": None, "": None, "MIT AND Apache-2.0": True, "Custom OR GPL-2.0": False}
    found = spark.createDataFrame(list(cases.items()), "l string, want boolean").select("l", "want", packages.permissive(F.col("l")).alias("got")).collect()
    assert all(r.got == r.want for r in found), found


def test_names_urls_versions(spark):
    one = spark.range(1)
    got = one.select(
        packages.npm_name(F.lit("@a/b")), packages.requirement_name(F.lit("foo-bar[x]>=1; python_version<'3'")), packages.repository_url(F.lit("git+https://github.com/a/b.git")),
        packages.repository_url(F.lit("a/b")), packages.satisfies(F.lit("1.10"), ">=1.9,<2"), packages.satisfies(F.lit("1.10"), "~=1"), scalars.gcd(F.lit(12), F.lit(18)), scalars.comb(F.lit(10), F.lit(3)),
    ).first()
    assert list(got) == ["a__b", "foo-bar", "https://github.com/a/b", "https://github.com/a/b", True, None, 6, 120]


def test_nix_recipes(spark, tmp_path):
    nix = """stdenv.mkDerivation { pname = "z"; version = "1.2"; nativeBuildInputs = [ cmake pkgs.ninja ]; nativeCheckInputs = [ py ];
      patches = [ ./fix.patch ]; doCheck = true; src = fetchurl { url = "https://s/z.tgz"; }; meta = { license = with lib; [ licenses.mit licenses.x ]; description = "d"; }; }"""
    bare = 'buildGoModule { name = "w-2.0.1"; }'
    for path, text in (("pkgs/z", nix), ("pkgs/w", bare), ("lib/a", nix), ("pkgs/top-level/b", nix), ("pkgs/none", "{ }")):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "default.nix").write_text(text)
    got = {r["name"]: r for r in recipes.nix_recipes(recipes.nix_tree(spark, str(tmp_path))).collect()}
    z, w = got["z"], got["w"]
    assert sorted(got) == ["w", "z"] and (z.version, z.licenses, z.build_system, z.build_deps, z.test_deps, z.patches, z.has_tests) == ("1.2", ["MIT", "x"], "cmake", ["cmake", "ninja"], ["py"], ["./fix.patch"], True)
    assert (z.unmapped, z.warnings, z.confidence, [s.url for s in z.sources]) == (["homepage"], ["patch reasons not parsed from source"], round(round(0.5 + 5 / 6 * 0.45, 2) * 0.95, 2), ["https://s/z.tgz"])
    assert (w.version, w.build_system, w.unmapped, w.confidence, w.phases) == ("2.0.1", "go", ["description", "homepage", "license", "src.url"], 0.65, ["configure", "build", "check", "install"])


def test_ports(spark, tmp_path):
    make = "PORTNAME=\tz\nPORTVERSION=1\nUSES= cmake:run \\\n pkgconfig\nLIB_DEPENDS=libx.so:devel/libx\nWWW= https://z\nOPTIONS_DEFINE=A B\n"
    texts = {"devel/z": make, "devel/z-slave": "PORTNAME=zs\nMASTERDIR=${.CURDIR}/../z\n", "lang/p": "PORTNAME=p\nUSES=perl5\nTEST_TARGET=check\nMASTERDIR= ${.CURDIR:H:H}/devel/z\nMAINTAINER=a@b c\n", "lang/q": "PORTNAME=q\nMASTERDIR=${X}/y\nUSES=qmake\n",
             "lang/up": "PORTNAME=up\nPORTVERSION=2\nMASTERDIR=${.CURDIR}/../../../etc\n", "lang/none": "MASTERDIR=${.CURDIR}/../q2\n"}
    for path, text in texts.items():
        (tmp_path / path / "files").mkdir(parents=True)
        (tmp_path / path / "Makefile").write_text(text)
    (tmp_path / "Makefile").write_text("PORTNAME=top\n")
    (tmp_path / "devel/z/files/patch-a").write_text("x")
    (tmp_path / "devel/z/files/other").write_text("x")
    ports = recipes.ports_tree(spark, str(tmp_path)).withColumn("vars", recipes.make_variables(F.col("value")))
    got = {r["name"]: r for r in recipes.port_recipes(recipes.inherited(ports)).collect()}
    assert sorted(got) == ["p", "q", "up", "z", "zs"]
    z, zs, p, q, up = (got[k] for k in ("z", "zs", "p", "q", "up"))
    assert (z.version, z.build_system, z.host_deps, z.options, z.patches, z.warnings, z.unmapped) == ("1", "cmake", ["libx"], ["A", "B"], ["files/patch-a"], ["patch reasons not parsed from source"], ["COMMENT", "LICENSE"])
    assert z.confidence == round(round(0.55 + 4 / 6 * 0.40, 2) * 0.95, 2) and z.sources[0].url == "https://z" and not z.has_tests
    assert (zs.version, zs.build_system, zs.host_deps, zs.warnings) == ("1", "cmake", ["libx"], ["slave port; merged from devel/z"])
    assert (p.build_system, p.has_tests, p.maintainers, p.version, p.warnings) == ("perl", True, ["a@b c"], "1", ["slave port; merged from devel/z"])
    assert (q.build_system, q.version, q.warnings) == ("freebsd_ports_make", "unknown", ["slave port; MASTERDIR not resolvable: '${X}/y'", "version not found; set to 'unknown'"])
    assert up.warnings == ["slave port; MASTERDIR not resolvable: '${.CURDIR}/../../../etc'"]


def test_registry_records(spark):
    npm = ['{"name": "@s/a", "dist-tags": {"latest": "9.0.0"}, "versions": {"9.0.0": {"dependencies": {"x": "1"}, "devDependencies": {"t": "1"}, "peerDependencies": {"h": "1"}, "license": {"type": "MIT"}, "dist": {"tarball": "u"}}, "10.0.0": {}}, "repository": "git+https://github.com/s/a.git", "keywords": ["k"]}',
           '{"name": "b", "versions": {"9.0.0": {"license": "ISC"}, "10.0.0": {"license": "X"}}}', '{"name": "c", "dist-tags": {"latest": "3"}, "versions": {"1": {"homepage": "h"}}, "license": "L"}', '{"name": "d"}', "no json", None]
    got = {r.ecosystem_id: r for r in recipes.npm_documents(spark.createDataFrame([(t,) for t in npm], "value string")).collect()}
    a, b, c, d = (got[k] for k in ("@s/a", "b", "c", "d"))
    assert len(got) == 4 and (a["name"], a.version, a.licenses, a.runtime_deps, a.build_deps, a.host_deps, a.repository, a.homepage, a.source_url, a.keywords) == ("s__a", "9.0.0", ["MIT"], ["x"], ["t"], ["h"], "https://github.com/s/a", "git+https://github.com/s/a.git", "u", ["k"])
    assert (b.version, b.licenses, c.version, c.homepage, c.licenses, d.version, d.licenses) == ("10.0.0", ["X"], "1", "h", ["L"], "", [])
    info = {"name": "A_b", "version": "1", "license": " MIT ", "home_page": "", "project_urls": {"Homepage": "https://h", "Code": "https://x/y", "Source Code": "https://github.com/a/b"}, "requires_dist": ["C_d>=1; python_version<'3'", "e; extra == 'x'", "c-d"], "classifiers": ["k"] * 12}
    doc = {"info": info, "urls": [{"packagetype": "wheel", "url": "w"}, {"packagetype": "sdist", "url": "s", "digests": {"sha256": "00"}}]}
    r = recipes.pypi_documents(spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("v"))).first()
    assert (r["name"], r.licenses, r.homepage, r.source_repository, r.runtime_deps, r.build_deps, r.source_url, r.source_sha256, len(r.classifiers)) == ("a-b", ["MIT"], "https://h", "https://github.com/a/b", ["c-d"], ["setuptools", "wheel"], "s", "00", 10)
    raw = [("a", '{"pname": "A", "version": "1", "description": "d", "homepage": "h", "license": ["MIT", ""], "position": "/r/pkgs/a.nix:3"}'), ("b", "{}"), ("c", "null")]
    got = {r.attr: r for r in recipes.nix_evaluated(spark.createDataFrame(raw, "attr string, raw string"), "/r").collect()}
    assert sorted(got) == ["a", "b"] and (got["a"]["name"], got["a"].licenses, got["a"].source_path, got["a"].confidence) == ("A", ["MIT"], "pkgs/a.nix", round(round(0.98, 2) * 0.97, 2))
    assert (got["b"].version, got["b"].source_path, len(got["b"].warnings), got["b"].unmapped) == ("unknown", "b", 2, ["meta.description", "meta.homepage", "meta.license"])


def test_registry_documents(spark):
    crate = {"crate": {"id": "a_b"}, "versions": [{"num": "2", "yanked": True, "license": "MIT"}, {"num": "1", "yanked": False, "license": "MIT OR GPL-2.0"}], "dependencies": [{"crate_id": "x_y", "kind": "normal", "optional": False}, {"crate_id": "o", "kind": "normal", "optional": True}, {"crate_id": "t", "kind": "dev", "optional": False}]}
    r = recipes.cargo_documents(spark.createDataFrame([(json.dumps(crate),)], "j string").select(F.parse_json("j").alias("v"))).first()
    assert (r["name"], r.version, r.permissive, r.runtime_deps, r.test_deps) == ("a-b", "1", True, ["x-y"], ["t"])


def test_snapshot(spark, tmp_path):
    (tmp_path / "reports").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"identity": {"canonical_name": "z", "ecosystem": "nixpkgs"}, "provenance": {"confidence": 0.9}}, indent=1))
    (tmp_path / "bad.json").write_text("not json")
    (tmp_path / "noid.json").write_text("{}")
    (tmp_path / "manifest.json").write_text('{"identity": {}}')
    (tmp_path / "reports" / "r.json").write_text('{"identity": {"canonical_name": "no"}}')
    got = records.snapshot(spark, [str(tmp_path)]).select("_name", "identity.ecosystem", "provenance.confidence").collect()
    assert [tuple(r) for r in got] == [("z", "nixpkgs", 0.9)]


def test_layers_and_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "src long, dst long")
    assert {r.node: r.layer for r in closure.layers(edges).collect()} == {3: 0, 2: 1, 1: 2, 5: None, 6: None}


def test_stream_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"k":"a","n":1}\n{"k":"a","n":2}\n{"k":"b","n":1}\n')
    q = incremental.watched(spark, str(tmp_path / "in"), "k string, n long", incremental.keeping_state(spark, str(tmp_path / "state"), "k", "n"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert {tuple(r) for r in incremental.state(spark, str(tmp_path / "state"), "k", "n").collect()} == {("a", 2), ("b", 1)}


def test_tables_become_invariants(spark):
    head = ("z", "t", "call_eq", None, None, "name", "{name} is {v}, {{x}}, {none}", "RFC 1", None, {"fn": "f", "v": "0"})
    tables = [
        (*head, ["name", "v", "kwargs", "skip_if", "v"], [(["{v}", "1", None, "never", "2"], None), (["b", "1", "k", None, "3"], {"fn": "g", "extra": "e"}), (["b"], None)]),
        ("y", "u", "k", "c", "p", None, None, None, "s", None, ["x"], [(["1"], None)]),
        ("y", "w", "k", "c", "p", None, None, None, "s", None, ["id", "description"], [(["1", "own"], None), ([None, None], None)]),
        ("y", "e", "k", "c", "p", None, None, None, "s", None, ["id"], []),
        ("y", "n", "k", "c", "p", None, None, None, "s", None, None, None),
    ]
    got = {(r.label, r.row): r for r in invariants.expand(spark.createDataFrame(tables, invariants.TABLE_SCHEMA)).collect()}
    a, b = got["t", 0], got["t", 1]
    assert (a.id, a.description, a.category, a.rfc_reference, a.skip_if, a.fields) == ("z.{v}", "{v} is 2, {x}, None", "general", "RFC 1", "never", {"fn": "f", "name": "{v}", "v": "2"})
    assert (b.id, b.skip_if, b.fields) == ("z.b", None, {"fn": "g", "name": "b", "v": "3", "kwargs": "k", "extra": "e"})
    assert {k: r.problem for k, r in got.items() if r.problem} == {("t", 2): "cells and columns differ in number", ("u", 0): "no id", ("w", 1): "no id"}
    c = got["w", 0]
    assert (c.id, c.description, c.category, c.skip_if, c.fields) == ("y.p.1", "own", "c", "s", {}) and len(got) == 6
    assert invariants.expand(spark.createDataFrame([], invariants.TABLE_SCHEMA)).count() == 0


def test_typed_bytes_and_conditions(spark):
    values = [("bytes_b64", "aGk=", b"hi"), ("bytes_hex", "68 69", b"hi"), ("bytes_ascii", "hi", b"hi"), ("bytes_ascii", "ü", None), ("bytes_hex", "zz", None), ("str", "hi", None), ("bytes_hex", None, b"")]
    found = spark.createDataFrame(values, "k string, v string, want binary").select("want", invariants.typed_bytes(F.col("k"), F.col("v")).alias("got")).collect()
    assert all(r.got == r.want for r in found), found
    cases = [("1.2.12", 'semver_satisfies(lib_version, "<1.3")', True), ("1.3", 'not semver_satisfies(lib_version, "<1.3")', True), ("", 'semver_satisfies(lib_version, "<1.3")', False), ("1", 'platform == "linux" or lib_version == "2"', True), ("1", "__import__('os')", False), ("1", "lib_version <", False), ("1", None, False)]
    cases += [("1", '(platform == "x" or True) and not (lib_version >= "2" and platform)', True), ("1", 'semver_satisfies(lib_version, ">=1") == (platform != "linux")', False), ("1", 'semver_satisfies(lib_version, "??")', False), ("x", 'semver_satisfies(lib_version, "")', False), ("1", '"" or platform', True)]
    cases += [("1.4.2", "semver_satisfies(lib_version, '~=1.3') and (lib_version < '2' or platform == 'bsd')", True), (None, "not lib_version", True), ("1", "len(platform) == 5", False), ("1", " not  False ", True)]
    found = spark.createDataFrame(cases, "version string, skip_if string, want boolean").select("want", invariants.skipped(F.col("skip_if"), F.col("version"), F.lit("linux")).alias("got")).collect()
    assert [r.got for r in found] == [r.want for r in found], found


def test_seeds(spark, tmp_path):
    ports = [(("Foo_Bar", "devel/py-foo"), [("PyPI",)]), (("foo-bar", "py-foo"), [("x",), ("PYPI",)]), (("a", "devel/py-a"), [("x",)]), (("b", "devel/b"), [("PYPI",)]), (("${X:tl}", "py-x"), [("PYPI",)]), ((None, "py-x"), [("PYPI",)]), (("n", None), None)]
    schema = "identity struct<canonical_name:string,ecosystem_id:string>, sources array<struct<url:string>>"
    names = seeds.python_names(spark.createDataFrame(ports, schema))
    assert [r.name for r in names.collect()] == ["foo-bar"]
    (tmp_path / "more.txt").write_text("# all\nfoo-bar # again\n\n zed \n")
    more = seeds.listed_names(spark.read.text(str(tmp_path / "more.txt")))
    seeds.write_names(seeds.with_more(names, more), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["foo-bar", "zed"]
    assert seeds.python_names(spark.createDataFrame([], schema)).count() == 0


def test_npm_files(spark):
    schema = "identity struct<canonical_name:string,ecosystem_id:string,version:string>, descriptive struct<license:array<string>,homepage:string>"
    rows = [(("s__p_q", "@s/p_q", "1.2"), (["MIT", "ISC"], 'https://x/"a"')), (("c", "", ""), ([], "")), ((None, None, None), None)]
    got = seeds.npm_files(spark.createDataFrame(rows, schema)).collect()
    made = [json.loads(r.content) for r in got if r.filename == "package.json"]
    assert [(m["name"], m["dependencies"], m["license"], m.get("homepage")) for m in made] == [("install-s-p-q", {"@s/p_q": "1.2"}, "MIT", 'https://x/"a"'), ("install-c", {"c": "*"}, "UNLICENSED", None), ("install-unknown", {"unknown": "*"}, "UNLICENSED", None)]
    assert {r.content for r in got if r.filename == ".npmrc"} == {"\n".join(seeds.NPM_SETTINGS) + "\n"}


SPEC = """
spec: z
version: ">=1"
invariant z.one:
  kind: constant_eq
  category: c
  name: MAX
  expected_value: 3
invariant z.call:
  call: a.f(1, [-2, "x"], k=(1, None)).g("y").h
  eq: !b64 aGk=
  rfc: R
invariant z.raises:
  call: f()
  raises: ValueError
invariant z.bare: {call: f()}
invariant z.deep: {call: f().a.b.c, eq: 1}
invariant z.run: {call: "f(open('x'))", eq: 1}
invariant z.kindless: {name: q}
invariant z.text: no mapping
table z.rows:
  kind: call_eq
  id_prefix: p
  function: f
  describe: "{id} gives {v}"
  columns: [id, v]
  rows:
    - [a, 1]
    - [b, !tuple [x, y], {function: g, skip_if: s}]
    - [c]
"""


def test_specifications(spark, tmp_path):
    (tmp_path / "z.yaml").write_text(SPEC)
    (tmp_path / "bad.yaml").write_text("a: [")
    (tmp_path / "list.yaml").write_text("- a")
    (tmp_path / "noname.yaml").write_text("version: 1")
    docs = specs.documents(spark, [str(tmp_path)])
    assert sorted((r._path.split("/")[-1], r.spec, (r.problem or "").split(":")[0]) for r in docs.collect()) == [("bad.yaml", None, "no YAML"), ("list.yaml", None, "no mapping"), ("noname.yaml", None, "no spec"), ("z.yaml", "z", "")]
    got = {r.id: r for r in specs.all_invariants(docs).withColumn("fields", F.to_json("fields")).collect()}
    fields = {k: json.loads(r.fields) for k, r in got.items() if r.fields}
    assert {k: r.problem for k, r in got.items() if r.problem} == {"z.bare": "call without eq or raises", "z.deep": "call can't be read", "z.run": "call can't be read", "z.kindless": "no kind", "z.text": "no mapping", None: "cells and columns differ in number"}
    assert fields["z.one"] == {"name": "MAX", "expected_value": 3} and (got["z.one"].category, got["z.one"].description) == ("c", "constant_eq: z.one")
    assert fields["z.call"] == {"function": "a.f", "args": [1, [-2, "x"]], "kwargs": {"k": {"type": "tuple", "value": [1, None]}}, "method": "g", "method_args": ["y"], "method_chain": "h", "expected": {"type": "bytes_b64", "value": "aGk="}}
    assert (got["z.call"].kind, got["z.call"].rfc_reference) == ("python_call_eq", "R")
    assert got["z.raises"].kind == "python_call_raises" and fields["z.raises"] == {"function": "f", "args": [], "expected_exception": "ValueError"}
    assert fields["z.p.a"] == {"function": "f", "v": 1} and got["z.p.a"].description == "a gives 1"
    assert fields["z.p.b"] == {"function": "g", "v": {"type": "tuple", "value": ["x", "y"]}, "skip_if": "s"}
    assert specs.all_invariants(docs.limit(0)).count() == 0


def test_evaluation(spark):
    cases = [
        ("cli_exits_with", 2, "", "", "2", False, True), ("cli_exits_with", None, "", "", "2", False, False), ("cli_stdout_eq", 0, "a b \n", None, "a b", False, True), ("cli_stdout_eq", 0, " a", None, "a", False, False),
        ("cli_stdout_contains", 0, "abc", "", "b", False, True), ("cli_stdout_matches", 0, "x\ny", "", "^y", False, False), ("cli_stdout_matches", 0, "x\ny", "", "^y", True, True), ("cli_stderr_contains", 1, "b", "a", "b", False, False),
        ("cli_stdout_contains", 0, "abc", "", None, False, False), ("call_eq", 0, "", "", "", False, None),
    ]
    found = spark.createDataFrame(cases, "k string, x int, o string, e string, w string, m boolean, want boolean").select("want", evaluate.output_holds(*map(F.col, "kxoewm")).alias("got")).collect()
    assert [r.got for r in found] == [r.want for r in found], found
    digests = [("sha256", b"", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", True), ("md5", None, "d41d8cd98f00b204e9800998ecf8427e", True), ("md5", b"a", "d41d8cd98f00b204e9800998ecf8427e", False), ("none", b"", "", False)]
    frame = spark.createDataFrame(digests, "a string, d binary, w string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", evaluate.known_digest(F.col("a"), F.col("d"), F.col("w")).alias("got")).collect())
    parts = frame.where("a = 'sha256'").select(evaluate.same_in_parts(F.col("a"), F.array(F.lit(b""), F.col("d")), F.col("w")).alias("got")).first()
    assert parts.got
    wanted = spark.createDataFrame([("s", "1", "A", 3), ("s", "2", "A", 4), ("s", "3", "B", 3), ("t", "4", "A", 3), ("s", "5", "A", None)], "spec string, id string, name string, expected_value int")
    constants = spark.createDataFrame([("s", "A", 3), ("s", "A", 3), ("s", "B", None)], "spec string, name string, value int")
    assert {r.id: r.passed for r in evaluate.constants_hold(wanted, constants).collect()} == {"1": True, "2": False, "3": False, "4": False, "5": False}


TEXTS = ["", "a", "fo", "foo bar", "  x\n    y\n\n \n  z", "\tx\n  y", "a/b/../c", "/../a//b/.", "//x/..", "///x", "../..", "../a/../..", "ü~*+ %", "a/./b/", "x" * 200]


def test_text_functions_equal_pythons(spark):
    x, raw = F.col("x"), F.col("x").cast("binary")
    found = spark.createDataFrame([(t,) for t in TEXTS], "x string").select(
        "x", scalars.base32(raw).alias("b32"), scalars.hmac(raw, F.lit(b"message")).alias("h256"), scalars.hmac(F.lit(b"key"), raw, 512).alias("h512"),
        scalars.quoted(x).alias("q"), scalars.unquoted(scalars.quoted(x)).alias("u"), scalars.normal_path(x).alias("path"), scalars.dedented(x).alias("d"),
    ).collect()
    for r in found:
        b = r.x.encode()
        assert r.b32 == base64.b32encode(b).decode(), r.x
        assert r.h256 == hmac.new(b, b"message", hashlib.sha256).hexdigest() and r.h512 == hmac.new(b"key", b, hashlib.sha512).hexdigest(), r.x
        assert (r.q, r.u) == (urllib.parse.quote(r.x), r.x), r.x
        assert (r.path, r.d) == (posixpath.normpath(r.x), textwrap.dedent(r.x)), r.x
    assert list(spark.createDataFrame([(None,)], "x string").select(scalars.normal_path(x), scalars.dedented(x), scalars.base32(raw), scalars.quoted(x)).first()) == [None] * 4


def test_numbers_equal_pythons(spark):
    cases = [(4, 6), (0, 3), (-4, 6), (7, 7), (2**31, 3)]
    for r in spark.createDataFrame(cases, "a long, b long").select("a", "b", scalars.lcm(F.col("a"), F.col("b")).alias("l"), scalars.normal_density(F.col("b").cast("double"), 5.0, 2.0).alias("p")).collect():
        assert r.l == math.lcm(r.a, r.b) and math.isclose(r.p, statistics.NormalDist(5, 2).pdf(r.b))
    close = [(1.0, 1.0 + 1e-10), (1.0, 1.1), (math.inf, math.inf), (math.inf, 1.0), (math.nan, math.nan), (0.0, 1e-300), (0.0, 0.0)]
    for r in spark.createDataFrame(close, "a double, b double").select("a", "b", scalars.is_close(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == math.isclose(r.a, r.b), r


def test_imports(spark):
    python = [("import a.b, c\nfrom __future__ import x\nfrom . import y\nfrom d.e import f\ndef g():\n    import c", ["a", "c", "d"]), ("import (", None), (None, []), ("", [])]
    assert all(r.got == r.want for r in spark.createDataFrame(python, "t string, want array<string>").select("want", imports.python_roots(F.col("t")).alias("got")).collect())
    node = "const a = require('a/b'); import x from \"node:fs\"; import 'c'; await import( './d' ); require(e)"
    got = spark.createDataFrame([(node,)], "t string").select(imports.node_requests(F.col("t")).alias("r")).select("r", F.transform("r", imports.node_root).alias("roots")).first()
    assert (got.r, got.roots) == (["./d", "a/b", "c", "node:fs"], [".", "a", "c", "fs"])


def test_pypi_files(spark):
    schema = "identity struct<canonical_name:string,ecosystem_id:string,version:string>, descriptive struct<summary:string,homepage:string,license:array<string>>, dependencies struct<runtime:array<string>>, sources array<struct<url:string>>, requires_python string"
    full = (("z", "Z", "1.2"), ('a "b"', "https://h", ["MIT"]), (["x>=1", "y"],), [("",), ("https://s",)], ">=3.9")
    got = {(r["name"], r.filename): r.content for r in seeds.pypi_files(spark.createDataFrame([full, (("c", "", ""), None, None, None, None)], schema)).collect()}
    assert got["Z", "requirements.txt"] == "Z==1.2\nx>=1\ny\n" and got["c", "requirements.txt"] == "c\n"
    head = "\n".join(seeds.PYTHON_BUILD)
    assert got["c", "pyproject.toml"] == head + '\nname = "c"\nlicense = {text = "UNKNOWN"}\n'
    assert got["Z", "pyproject.toml"] == head + (
        '\nname = "Z"\nversion = "1.2"\ndescription = "a \\"b\\""\nrequires-python = ">=3.9"\nlicense = {text = "MIT"}\ndependencies = [\n    "x>=1",\n    "y",\n]\n'
        '\n[project.urls]\nHomepage = "https://h"\n\n# Source: https://s\n'
    )


def test_layers_do_not_stop_early(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(4)], "src int, dst int")
    with pytest.raises(ValueError):
        closure.layers(edges, most=2)
    assert {r.node: r.layer for r in closure.layers(edges).collect()} == {i: i for i in range(5)}


def test_versions_of_many_numbers(spark):
    cases = [("1.2.3.4.5.6.7", "<1.2.3.4.5.6.8", True), ("1.2.3.4.5.6.7", "==1.2.3.4.5.6.8", False), ("1.2", "==1.2.0.0.0.0.0.0", True), ("1.2.0.0.0.0.0.1", ">1.2", True), (None, ">1.2", True), ("2.0rc1", ">=2.0", False), ("x", "==1", True)]
    got = spark.range(1).select(*[packages.satisfies(F.lit(v).cast("string"), c).alias(f"c{i}") for i, (v, c, _) in enumerate(cases)]).first()
    assert list(got) == [want for *_, want in cases]


def test_layers_of_chains_branches_and_circles(spark):
    import random

    r = random.Random(4)
    edges = [(i + 1, i) for i in range(60)] + [(r.randint(1, 60), 0) for _ in range(5)] + [(b, a) for a, b in (sorted(r.sample(range(100, 140), 2)) for _ in range(70))]
    edges += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (204, 5), (205, 205), (206, 60)]
    want, deps = {}, {}
    for a, b in edges:
        deps.setdefault(a, set()).add(b)
        deps.setdefault(b, set())
    for _ in deps:
        want |= {k: 1 + max((want[d] for d in v), default=-1) for k, v in deps.items() if v <= want.keys()}
    got = {x.node: x.layer for x in closure.layers(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: want.get(k) for k in deps} and closure.layers(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_scratch_drops_what_is_written_inside(spark):
    from lodemill import shared

    with shared.scratch(spark):
        kept = shared.written(closure.layers(spark.createDataFrame([(1, 2)], "src long, dst long")), "kept")
        path = kept.inputFiles()[0].split("/kept-")[0].removeprefix("file:")
        assert len(kept.collect()) == 2 and any(Path(path).glob("layered-*"))
    assert not any(Path(path).glob("kept-*"))


def test_versions_equal_the_packaging_library(spark):
    import re

    specifiers, version = pytest.importorskip("packaging.specifiers"), pytest.importorskip("packaging.version")
    versions = ["1", "1.0.1", "1.10", "2.0rc1", "2.0", "2.0.post1", "2.0.dev3", "2.0a1", "1!1.0", "2.0+local", "v3.1", "2.0.0.0.0.0.1", "abc", "3.0-1", "2.0rc1.post2"]
    constraints = [">=2.0", ">=2.0rc1", "<2.0", "<2.0rc2", "<=2.0", "==2.0", "!=2.0", "==2.*", "!=2.*", "~=1.2", "~=1.2.0", ">1.0 <3", ">=1.0,<2", ">2.0", ">2.0.post0", "==2.0rc1", ">=1!0", "==1.0.0.0.0.0.0"]
    frame = spark.createDataFrame([(v,) for v in versions], "v string")
    pairs = spark.createDataFrame([(v, c) for v in [*versions, None, ""] for c in [*constraints, None, "", "n/a yet", "=>1", ">=1 ~=2", ">=1,, <2,", "==1.x.*"]], "v string, c string")
    for r in pairs.select("v", "c", packages.satisfies(F.col("v"), F.col("c")).alias("got")).collect():
        text = re.sub(r"\s+(?=[<>=!])", ",", (r.c or "").strip())
        try:
            want = True if not r.v or not r.c or r.c.upper().startswith("N/A") else version.Version(r.v) in specifiers.SpecifierSet(text)
        except version.InvalidVersion:
            want = None if r.c in ("=>1", ">=1 ~=2", "==1.x.*") else True
        except specifiers.InvalidSpecifier:
            want = None
        assert r.got == want or r.c in ("=>1", ">=1 ~=2", "==1.x.*"), (r.v, r.c, r.got)
    for r in frame.select("v", *[packages.satisfies(F.col("v"), c).alias(f"c{i}") for i, c in enumerate(constraints)]).collect():
        for i, c in enumerate(constraints):
            try:
                want = version.Version(r.v) in specifiers.SpecifierSet(re.sub(r"\s+(?=[<>=!])", ",", c))
            except version.InvalidVersion:
                want = True
            assert r[f"c{i}"] == want, (r.v, c)


def test_backends_licences(spark):
    backends = [("ctypes", None, "c"), (None, None, "c"), ("cli", "node", "javascript"), ("cli", "x", "python"), ("node", None, "javascript"), ("node_cleanroom", None, "node_cleanroom"), ("python_cleanroom", None, "python_cleanroom"), ("rust_module", None, "rust"), ("other", None, "python")]
    assert all(r.got == r.want for r in spark.createDataFrame(backends, "b string, c string, want string").select("want", packages.backend_language(F.col("b"), F.col("c")).alias("got")).collect())
    licences = [(["MIT"], True, "permissive"), (["MIT", "GPL-2.0"], False, "copyleft"), (["X"], True, "unknown licence"), ([], True, "no licence given"), (None, True, "no licence given")]
    found = spark.createDataFrame(licences, "l array<string>, allowed boolean, reason string").select("allowed", "reason", packages.licences_allowed(F.col("l")).alias("g")).collect()
    assert all((r.g.allowed, r.g.reason) == (r.allowed, r.reason) for r in found)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.json").write_text('{"identity": {"canonical_name": "deep"}}')
    (tmp_path / "a.json").write_text('{"identity": {"canonical_name": ""}, "name": "a", "pname": "b"}')
    (tmp_path / "n.json").write_text('{"identity": {}}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "z.spec.json").write_text('{"identity": {"canonical_name": "zed"}}')
    (tmp_path / "y.spec.json").write_text("{}")
    every = records.snapshot(spark, [str(tmp_path)])
    assert sorted(r._name for r in every.collect()) == ["a", "deep", "unknown", "zed"]
    assert sorted(r._name for r in records.snapshot(spark, [str(tmp_path)], nameless=records.LEFT_OUT, names=("identity.canonical_name",)).collect()) == ["deep", "zed"]
    assert records.flat_documents(spark, str(tmp_path), "[an]*.json").count() == 2 and sorted(r.spec for r in records.compiled_specs(spark, str(tmp_path)).collect()) == ["y", "zed"]
    records.export_records(every, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted(r["name"] for r in back.collect()) == ["a", "deep", "unknown", "zed"] and json.loads(back.where("name = 'a'").first().value)["pname"] == "b"
    (tmp_path / "base.json").write_text('[{"id": "1", "passed": true}, {"id": "2", "passed": false, "message": "m"}]')
    assert [(r.id, r.passed) for r in records.baseline(spark, str(tmp_path / "base.json")).orderBy("id").collect()] == [("1", True), ("2", False)]
    (tmp_path / "eval").mkdir()
    (tmp_path / "eval" / "1.json").write_text('{"a": {"pname": "A"}, "b": null}')
    assert [(r.attr, json.loads(r.raw)) for r in records.evaluated(spark, str(tmp_path / "eval")).collect()] == [("a", {"pname": "A"})]
    (tmp_path / "c.yaml").write_text("a: {x: 1}\nb: 2\n")
    assert records.read_settings([str(tmp_path / "c.yaml"), str(tmp_path / "none.yaml")], {"a": {"x": 0, "y": 3}, "b": {"q": 1}}) == {"a": {"x": 1, "y": 3}, "b": 2}
    things = spark.createDataFrame([("p", b"1"), ("q", b"1"), ("r", b"2")], "name string, content binary")
    first = {r["name"]: r.url for r in records.stored(things, str(tmp_path / "store")).collect()}
    assert first["p"] == first["q"] != first["r"] and records.stored(things, str(tmp_path / "store")).count() == 3 and spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_state_grows_with_batches_not_with_itself(spark, tmp_path):
    at, held, sizes = str(tmp_path / "state"), {}, []
    keep = incremental.keeping_state(spark, at, "k", "n")

    def rows_written():
        return {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "state").iterdir()}

    before = {}
    for batch in range(17):
        new = {(batch * 5 + i) % 40: batch * 100 + i for i in range(10)} | {1000 + batch: batch}
        held |= new
        for _ in range(1 + (batch == 9)):  # a batch that is repeated changes nothing
            keep(spark.createDataFrame(list(new.items()), "k long, n long"), batch)
        now = rows_written()
        sizes.append(sum(n for name, n in now.items() if name not in before))
        before = now
        if batch in (0, 7, 8, 16):
            assert {tuple(r) for r in incremental.state(spark, at, "k", "n").collect()} == set(held.items())
    # but for the two times when eight batches were put together, a batch writes its own 11 rows; merged batches are gone
    assert [n for i, n in enumerate(sizes) if (i + 1) % 8] == [11] * 15 and sorted(before) == ["0-7", "16-16", "8-15"]
    with pytest.raises(FileNotFoundError):
        incremental.state(spark, str(tmp_path / "none"), "k", "n")


def test_state_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"k": "a", "n": i}) + "\n" + json.dumps({"k": str(i), "n": i}) + "\n")
        q = incremental.watched(spark, str(tmp_path / "in"), "k string, n long", incremental.keeping_state(spark, str(tmp_path / "state"), "k", "n"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
        assert {tuple(r) for r in incremental.state(spark, str(tmp_path / "state"), "k", "n").collect()} == {("a", i)} | {(str(j), j) for j in range(i + 1)}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["0-0", "1-1", "2-2"]


def test_runs_that_come_in_several_batches(spark, tmp_path):
    base = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, passed boolean")
    at = str(tmp_path / "runs")
    each = incremental.against_baseline(base, ["id"], at)
    schema = "run string, id string, passed boolean, n_results long"

    def batch(n, *rows):
        each(spark.createDataFrame(rows, schema), n)
        return sorted(tuple(r) for r in spark.read.parquet(f"{at}/diff/batch={n}").select("run", "id", "change").collect())

    assert batch(0, ("r1", "a", True, 3), ("r2", "a", False, None)) == []
    assert batch(1, ("r1", "b", True, None)) == []  # nothing is removed while a run is open
    for _ in range(2):  # and the same again, as after a failure
        assert batch(2, ("r1", "c", True, None), ("r2", "x", True, None)) == [("r1", "c", "fix")]
    assert batch(3, ("r2", "a", False, None), ("r2", "x", True, 3)) == []  # results that come again count once
    assert batch(4, ("r2", "b", True, None)) == [("r2", "a", "regression"), ("r2", "c", "removed"), ("r2", "x", "added")]
    assert batch(5, ("r3", "a", True, 2), ("r3", "b", True, 2), ("r4", "c", False, 1)) == [("r3", "c", "removed"), ("r4", "a", "removed"), ("r4", "b", "removed")]
    assert batch(6) == [] and sorted(p.name for p in (tmp_path / "runs" / "open").iterdir()) == ["batch=5", "batch=6"]
    assert [p.name for p in (tmp_path / "runs" / "results").iterdir() if p.name.startswith("batch=") and int(p.name[6:]) < 5] == []


def test_run_in_two_files_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = spark.createDataFrame([("a", True), ("b", True)], "id string, passed boolean")
    each = incremental.against_baseline(base, ["id"], str(tmp_path / "out"))
    for n, text in enumerate(('{"run":"r","id":"a","passed":true,"n_results":2}\n', '{"run":"r","id":"b","passed":true}\n')):
        (tmp_path / "in" / f"{n}.json").write_text(text)
        incremental.watched(spark, str(tmp_path / "in"), "run string, id string, passed boolean, n_results long", each, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "diff")).count() == 0


def test_rewritten_files_run_again(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    seen = []

    def look():
        seen.clear()
        n = incremental.rerun(spark, str(tmp_path / "in"), "k string", lambda rows, batch: seen.append((batch, sorted((r.k, r._path.rsplit("/", 1)[1]) for r in rows.collect()))), str(tmp_path / "kept"))
        return n, seen[:]

    def write(name, k, when):
        (tmp_path / "in" / name).write_text(json.dumps({"k": k}) + "\n")
        os.utime(tmp_path / "in" / name, (when, when))

    write("a.json", "1", 1000)
    write("b.json", "2", 1000)
    assert look() == (2, [(0, [("1", "a.json"), ("2", "b.json")])]) and look() == (0, [])
    write("a.json", "3", 2000)
    assert look() == (1, [(1, [("3", "a.json")])]) and look() == (0, [])
    write("b.json", "2", 3000)  # touched, not changed
    write("c.json", "4", 3000)
    assert look() == (1, [(2, [("4", "c.json")])])
    (tmp_path / "in" / "a.json").unlink()
    assert look() == (0, []) and len(list((tmp_path / "kept").iterdir())) == 2
    write("a.json", "3", 2000)  # new again
    with pytest.raises(ZeroDivisionError):
        incremental.rerun(spark, str(tmp_path / "in"), "k string", lambda rows, batch: 1 // 0, str(tmp_path / "kept"))
    assert look()[0] == 1 and look() == (0, [])


def test_append_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"id":"a","passed":false}\n{"id":"b","passed":true}\n{"id":"d","passed":true}\n')
    stream = spark.readStream.schema("id string, passed boolean").json(str(tmp_path / "in"))
    incremental.appended(stream, str(tmp_path / "log"), str(tmp_path / "cp2"), once=True).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_files_one_a_row(spark, tmp_path):
    at = tmp_path / "tree"
    tree = {f"{i % 3}/d/{i}.txt": f"text {i}\n" for i in range(40)} | {"top.txt": "é", "empty": None}
    files.write_files(spark.createDataFrame(list(tree.items()), "filename string, content string").repartition(4), str(at))
    held = lambda: {str(p.relative_to(at)): p.read_text() for p in at.rglob("*") if p.is_file()}
    assert held() == {k: v or "" for k, v in tree.items()} and not list(at.glob("_staging*"))
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(at)).count()
    assert back == 41  # Spark's readers leave empty files out
    files.write_files(spark.createDataFrame([("new/x", "1")], "filename string, content string"), f"file://{at}")
    assert len(held()) == 43
    bad = [[("a", "1"), ("../b", "2")], [("a", "1"), ("x/../a", "2")], [("a", "1"), (None, "2")], [("a", "1"), ("/b", "2")]]
    for rows in bad:  # a job that fails leaves nothing
        with pytest.raises(Exception):  # noqa: B017
            files.write_files(spark.createDataFrame(rows, "filename string, content string").repartition(2), str(at))
        assert len(held()) == 43 and not list(at.glob("_staging*"))
    files.write_files(spark.createDataFrame([("one", bytearray(b"\xff"))], "filename string, content binary"), str(at), replace=True)
    assert [p.name for p in at.iterdir()] == ["one"] and (at / "one").read_bytes() == b"\xff"


def test_records_one_file_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (name, eco) in enumerate([("zlib", "ports"), ("zlib", "ports"), ("zlib", "nix"), ("a/b c", "nix")]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"identity": {"canonical_name": name, "ecosystem": eco}, "n": i}))
    snap = records.snapshot(spark, [str(tmp_path / "in")])
    files.export_files(snap.withColumn("eco", F.col("identity.ecosystem")), str(tmp_path / "out"), ecosystem="eco")
    found = {str(p.relative_to(tmp_path / "out")): json.loads(p.read_text())["n"] for p in (tmp_path / "out").rglob("*.json")}
    assert found == {"ports/zlib.json": 0, "ports/zlib_1.json": 1, "nix/zlib.json": 2, "nix/a_b_c.json": 3}
    assert records.snapshot(spark, [str(tmp_path / "out")]).count() == 4


def test_edges_files_and_lint(spark):
    nested = spark.createDataFrame([("p", ("e",), (["a", "b", "a"], None, ["b"], []))], "_path string, identity struct<ecosystem:string>, dependencies struct<build:array<string>,host:array<string>,runtime:array<string>,test:array<string>>")
    assert sorted(tuple(r) for r in rank.dependency_edges(nested).collect()) == [("p", "e", "build", "a"), ("p", "e", "build", "b"), ("p", "e", "runtime", "b")]
    texts = [("bad", "no"), ("list", "[]"), ("rec", "{}"), ("null", None)]
    got = {r._path: (r.n_issues, r.valid) for r in validate.file_validity(spark.createDataFrame(texts, "_path string, value string")).collect()}
    assert got["bad"] == got["list"] == got["null"] == (1, False) and got["rec"][0] > 13
    sources = [('spec: a\nbackend: rust_module(x)\n',), ('spec: b\nbackend: python_cleanroom(x)\nnotes:\n  - "Expose dumps: json.dumps"\n',), ("spec: c\nbackend: rust_module(y)\n",), ("none",)]
    found = validate.lint(spark.createDataFrame(sources, "value string"), spark.createDataFrame([("c",)], "spec string"))
    assert sorted((r.spec, r.level) for r in found.collect()) == [("a", "ERROR"), ("b", "WARN")]
    ranked = rank.take_ranked(spark.createDataFrame([("a", 5, "x,y", True), ("b", 9, "y", True), ("c", 9, "x", True), ("d", 9, "x", False)], "dep string, ref_count long, ecosystems string, in_snapshot boolean"), ["x"], 2, 5)
    assert [r.dep for r in ranked.collect()] == ["c", "a"]


WHOLE = """
spec: z
version: ">=1.2"
backend: python_cleanroom(z_cr)
docs: https://d
rfcs: [RFC 1950 — ZLIB, {rfc: RFC 2, title: t}, other]
blocks: [z]
provenance: {derived_from: [a]}
constants:
  levels: {BEST: 9, NONE: {value: 0, description: d}}
  names: [{name: N, value: x}, {value: 1}]
functions:
  f: {params: {a: {type: int}, b: {}}, returns: int, pre: p, post: q}
error_model: {semantics: s, codes: {E1: {value: -1}}}
invariant z.one: {kind: constant_eq, name: BEST, expected_value: 9}
"""


def test_whole_specifications(spark, tmp_path):
    (tmp_path / "z.yaml").write_text(WHOLE)
    (tmp_path / "y.yaml").write_text("spec: y\nbackend: node(left-pad)\nesm: true\nerror_model: python_exceptions\n")
    (tmp_path / "x.yaml").write_text("spec: x\nbackend: ctypes(libx)\n")
    docs = specs.documents(spark, [str(tmp_path)])
    got = {r.spec: r for r in specs.headers(docs).collect()}
    z, y, x = got["z"], got["y"], got["x"]
    assert (z.spec_for_versions, z.backend, z.module_name, z.backend_lang, z.cleanroom_path, z.blocks, z.derived_from, z.not_derived_from) == (">=1.2", "python_cleanroom", "z_cr", "python_cleanroom", "cleanroom/python/z_cr", ["z"], ["a"], [])
    assert [tuple(r) for r in z.rfcs] == [("RFC 1950", "ZLIB"), ("RFC 2", "t"), ("other", "")]
    assert (y.backend, y.command, y.module_name, y.esm, y.spec_for_versions) == ("cli", "node", "left-pad", True, ">=0") and (x.backend, x.soname_patterns, x.module_name) == (None, ["libx"], None)
    assert sorted((r.group, r["name"], r.value, r.description) for r in specs.constants(docs).collect()) == [("levels", "BEST", "9", None), ("levels", "NONE", "0", "d"), ("names", "N", "x", None)]
    f = specs.functions(docs).first()
    assert (f["name"], [p["name"] for p in f.parameters], f.return_type, f.preconditions, f.postconditions) == ("f", ["a", "b"], "int", "p", "q")
    errors = {r.spec: r for r in specs.error_models(docs).collect()}
    assert (errors["z"].return_code_semantics, errors["z"].error_codes[0]["name"], errors["y"].error_stickiness, errors["x"].stream_error_field) == ("s", "E1", "N/A — each call is stateless", "null")
    whole = specs.compiled(docs)
    assert {r.spec for r in whole.collect()} == {"x", "y", "z"} and whole.select(F.explode(validate.spec_issues("v")).alias("i")).count() == 0
    assert json.loads(whole.where("spec = 'z'").select(F.to_json("v").alias("j")).first().j)["invariants"][0]["spec"] == {"name": "BEST", "expected_value": 9}


def test_compiled_specifications_keep_types_wire_formats_and_codes(spark):
    made = {
        "a": ({"types": {"T": {"fields": [{"name": "x", "type": "int"}]}}, "wire_formats": {"frame": {"magic": "1f8b", "parts": [1, 2.5, None]}}, "error_model": {"semantics": "s", "codes": {"E1": {"value": -1, "when": "bad \\" + '"q"'}, "E2": "text", "E3": {"name": "own", "value": 2}, "E4": {}}}},
              [{"name": "E1", "value": -1, "when": "bad \\" + '"q"'}, {"name": "E2"}, {"name": "own", "value": 2}, {"name": "E4"}]),
        "b": ({"types": [], "wire_formats": [1], "error_model": {"codes": [{"name": "E9", "value": [1]}, "plain"], "stderr": "err"}}, [{"name": "E9", "value": [1]}, "plain"]),
        "c": ({"types": None, "error_model": "python_exceptions"}, []), "d": ({"types": ["t"], "error_model": {"codes": 5}}, []), "e": ({}, []),
    }
    docs = specs.parsed(spark.createDataFrame([(n, json.dumps({"spec": n} | x)) for n, (x, _) in made.items()], "_path string, value string"))
    got = {r.spec: json.loads(r.j) for r in specs.compiled(docs).select("spec", F.to_json("v").alias("j")).collect()}
    assert {n: sorted(v["error_model"]["error_codes"], key=str) for n, v in got.items()} == {n: sorted(codes, key=str) for n, (_, codes) in made.items()}
    assert {n: v["types"] for n, v in got.items()} == {"a": made["a"][0]["types"], "b": {}, "c": {}, "d": ["t"], "e": {}}
    assert {n: v["wire_formats"] for n, v in got.items()} == {n: x.get("wire_formats") if n == "a" else {} for n, (x, _) in made.items()}
    assert got["b"]["error_model"]["stream_error_field"] == "err" and got["a"]["error_model"]["return_code_semantics"] == "s"
    assert specs.compiled(docs).select(F.explode(validate.spec_issues("v")).alias("i")).where("spec = 'a'").count() == 0


def test_calls_are_made_whatever_the_size_of_their_arguments(spark):
    cases = [
        ("math", "gcd", [48000, 18000], 6000, True), ("math", "lcm", [10**9, 10**9 + 7], 10**9 * (10**9 + 7), True), ("math", "comb", [10**9, 2], 10**9 * (10**9 - 1) // 2, True), ("math", "floor", [1e300], int(1e300), True), ("math", "gcd", [48000, 18000], 1, False),
        ("math", "comb", [10**30, 10**30 - 1], 10**30, True), ("math", "perm", [10**20, 1], 10**20, True), ("math", "factorial", [10**8], 1, None), ("math", "factorial", [10**400], 1, None), ("math", "comb", [10**9, 5 * 10**8], 1, None), ("math", "perm", [10**9], 1, None), ("math", "comb", [5, 10**9], 0, True), ("math", "prod", [list(range(1, 20001, 400))], math.prod(range(1, 20001, 400)), True),
    ]
    rows = [(i, m, json.dumps({"function": f, "args": a, "expected": e})) for i, (m, f, a, e, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, module string, body string").select("i", evaluate.python_holds(F.col("module"), F.lit("python_call_eq"), F.col("body")).alias("r")).orderBy("i").collect()
    assert [r.r.passed for r in got] == [c[-1] for c in cases], [(c, r.r) for c, r in zip(cases, got) if r.r.passed != c[-1]]
    assert all("digits" in r.r.message for r in got if r.r.passed is None)


def test_hash_kinds_of_copies_and_two_names(spark):
    sha, one, both = (hashlib.sha256(x).hexdigest() for x in (b"x", b"a", b"ab"))
    row = spark.range(1).select(
        evaluate.copy_independent(F.lit("sha256"), F.lit(b"a"), F.lit(b"b"), F.lit(one), F.lit(both)).alias("a"), evaluate.copy_independent(F.lit("sha256"), F.lit(b"a"), F.lit(b"b"), F.lit(both), F.lit(both)).alias("b"), evaluate.two_ways(F.lit("SHA256"), F.lit("sha256"), F.lit(None).cast("binary")).alias("c"),
        evaluate.two_ways(F.lit("sha256"), F.lit("md5"), F.lit(b"x")).alias("d"), evaluate.two_ways(F.lit("q"), F.lit("q"), F.lit(b"x")).alias("e"), evaluate.same_in_parts(F.lit("sha256"), F.array(F.lit(b""), F.lit(b"x")), F.lit(sha)).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, False, False, True)


def test_typed_values_and_python_invariants(spark):
    cases = [('{"type": "bytes_b64", "value": "aGk="}', '{"bytes":"6869"}'), ('{"type": "bytes_hex", "value": "zz"}', None), ('{"type": "tuple", "value": [1, 2]}', "[1,2]"), ('{"type": "str", "value": "a\\"b"}', '"a\\"b"'), ('{"type": "int", "value": "7"}', "7"),
             ('{"type": "float", "value": 2}', "2"), ('{"type": "bool", "value": 0}', "false"), ('{"type": "bool", "value": "x"}', "true"), ('{"type": "null"}', "null"), ('{"type": "json", "value": {"b": 1, "a": [2.0]}}', '{"a":[2],"b":1}'), ("1.0", "1"), ("[1]", "[1]"), ('{"type": "other"}', '{"type":"other"}'), ("null", "null")]
    found = spark.createDataFrame(cases, "v string, want string").select("v", "want", invariants.canonical(F.parse_json("v")).alias("got")).collect()
    assert all(r.got == r.want for r in found), [tuple(r) for r in found if r.got != r.want]
    calls = [
        ("math", "python_call_eq", {"function": "gcd", "args": [12, 18], "expected": 6}, True), ("math", "python_call_eq", {"function": "gcd", "args": [12, 18], "expected": 5}, False), ("os", "python_call_eq", {"function": "system", "args": ["x"]}, None),
        ("base64", "python_call_eq", {"function": "b64encode", "args": [{"type": "bytes_ascii", "value": "hi"}], "expected": {"type": "bytes_ascii", "value": "aGk="}}, True), ("struct", "python_call_eq", {"function": "unpack", "args": ["<H", {"type": "bytes_hex", "value": "0100"}], "expected": [1]}, True),
        ("json", "python_call_raises", {"function": "loads", "args": ["{"], "expected_exception": "json.JSONDecodeError"}, True), ("json", "python_call_raises", {"function": "loads", "args": ["{}"], "expected_exception": "ValueError"}, False), ("json", "python_call_raises", {"function": "loads", "args": ["{"], "expected_exception": "ValueError"}, True),
        ("base64", "python_encode_decode_roundtrip", {"encode_fn": "b85encode", "decode_fn": "b85decode", "inputs_b64": ["", "aGk="]}, True), ("struct", "python_struct_roundtrip", {"format": ">I", "values": [7]}, True), ("struct", "python_struct_roundtrip", {"format": ">B", "values": [700]}, False),
        ("hashlib", "python_set_contains", {"attribute": "algorithms_guaranteed", "must_contain": ["md5"]}, True), ("hashlib", "python_set_contains", {"attribute": "algorithms_guaranteed", "must_contain": ["q"]}, False), ("math", "call_eq", {}, None), (None, None, None, None),
    ]
    rows = [(m, k, json.dumps(b) if b is not None else None, w) for m, k, b, w in calls]
    found = spark.createDataFrame(rows, "m string, k string, b string, want boolean").select("want", evaluate.python_holds(F.col("m"), F.col("k"), F.col("b")).alias("got")).collect()
    assert [r.got.passed for r in found] == [r.want for r in found], found
    sizes = [("sha256", "digest_size", "32"), ("sha512", "block_size", "128"), ("md5", "name", "md5"), ("x", "name", None)]
    found = spark.createDataFrame(sizes, "a string, b string, want string").select("want", evaluate.hash_attribute(F.col("a"), F.col("b")).alias("got"), evaluate.digest_consistent(F.col("a"), F.lit(b"1")).alias("same")).collect()
    assert [r.got for r in found] == [r.want for r in found] and [r.same for r in found] == [True, True, True, False]


def test_further_functions_equal_pythons(spark):
    import base64 as b64
    import binascii
    import calendar
    import colorsys
    import csv
    import difflib
    import html
    import io
    import itertools
    import shlex
    import struct
    import unicodedata
    import uuid

    one = lambda *columns: list(spark.range(1).select(*columns).first())
    text = "  The quick\tbrown fox\n jumps over extraordinarily lazy dogs "
    got = one(texts.wrapped(F.lit(text), 12), texts.wrapped(F.lit(" \n"), 5), texts.template(F.lit("$a ${b} $$ $c $"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))), texts.ratio(F.lit("abcd"), F.lit("bcde")), texts.ratio(F.lit(""), F.lit("")))
    assert got == [textwrap.wrap(text.strip(), 12, break_long_words=False), [], "1 2 $ $c $", 0.75, 1.0]
    assert one(texts.close_matches(F.lit("appel"), ["ape", "apple", "peach", "puppy"]), texts.unified_diff(F.lit("a\nb\nc"), F.lit("a\nx\nc"))) == [difflib.get_close_matches("appel", ["ape", "apple", "peach", "puppy"]), ["@@ -1,3 +1,3 @@", " a", "-b", "+x", " c"]]
    for raw in ("a,b", '"a, ""x""",b,', "", '"q"rest,z'):
        want = ["q", "z"] if "rest" in raw else (next(csv.reader([raw])) if raw else [""])
        assert one(texts.csv_fields(F.lit(raw))) == [want], raw
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(["a,b", 'c"', "d", "e\nf"])
    assert one(texts.csv_line(F.array(*map(F.lit, ["a,b", 'c"', "d", "e\nf"])))) == [out.getvalue()]
    assert one(texts.matched(F.lit("xxabc"), "a(b)"), texts.fully_matches(F.lit("ab"), "a|ab"), texts.json_sorted(F.lit('{"b": 1, "a": [2]}')), texts.toml_json(F.lit("a = 1\n[b]\nc = 'x'")), texts.toml_json(F.lit("=")))[1:] == [True, '{"a":[2],"b":1}', '{"a": 1, "b": {"c": "x"}}', None]
    assert tuple(one(texts.matched(F.lit("xxabc"), "a(b)"))[0]) == ("ab", 2, 4) and one(texts.xml_texts(F.lit("<a><b>1</b><b>2</b></a>"), "a/b/text()")) == [["1", "2"]]
    query = "a=1&b=x+y&a=%20z&c=&d"
    assert one(texts.query_values(F.lit(query))) == [urllib.parse.parse_qs(query)] and one(texts.urlencoded(F.create_map(F.lit("a b"), F.lit("c&d")))) == [urllib.parse.urlencode({"a b": "c&d"})]
    assert one(texts.url_joined(F.lit("http://h/a/b?q"), F.lit("../c"))) == ["http://h/c"]
    page = "<p>a &amp; b<br/><!-- <i> --><script>x < y</script><B>c</B>"
    assert one(texts.html_tags(F.lit(page)), texts.html_text(F.lit(page)), texts.html_unescaped(F.lit("&eacute;&#39;"))) == [["p", "br", "script", "b"], "a & bc", html.unescape("&eacute;&#39;")]
    for raw in (b"", b"hello", bytes(range(256))):
        r = one(texts.base85(F.lit(raw)), texts.from_base85(texts.base85(F.lit(raw))), texts.crc_hqx(F.lit(raw)))
        assert (r[0], bytes(r[1]), r[2]) == (b64.b85encode(raw).decode(), raw, binascii.crc_hqx(raw, 0))
    assert bytes(one(texts.packed("<HI", F.array(F.lit(1), F.lit(2))))[0]) == struct.pack("<HI", 1, 2) and one(texts.unpacked("<H", F.lit(b"\x01\x00")), texts.unpacked("<H", F.lit(b"\x01"))) == [[1], None]
    assert one(texts.uuid3(str(uuid.NAMESPACE_DNS), F.lit("x"))) == [str(uuid.uuid3(uuid.NAMESPACE_DNS, "x"))] and one(texts.shell_words(F.lit("a 'b c' \\d")), texts.shell_words(F.lit("a '"))) == [shlex.split("a 'b c' \\d"), None]
    assert one(texts.mime_type(F.lit("http://x/a.html")), texts.mime_type(F.lit("a.tgz")), texts.mime_type(F.lit("a.nothing")), texts.category(F.lit("é")), texts.normalized(F.lit("é"))) == ["text/html", "application/x-tar", None, unicodedata.category("é"), "é"]
    x = F.lit("-1.25").cast("decimal(10,2)")
    assert [str(v) for v in one(*[texts.quantized(x, 1, m) for m in ("half_even", "half_up", "ceiling", "floor", "down")])] == ["-1.2", "-1.3", "-1.2", "-1.3", "-1.2"]
    assert tuple(one(texts.fraction(F.lit(6), F.lit(-4)))[0]) == (-3, 2) and one(texts.fraction(F.lit(1), F.lit(0))) == [None]
    assert one(texts.permutations_of(F.lit(5), F.lit(2)), texts.permutations_of(F.lit(2), F.lit(3)), texts.distance(F.array(F.lit(0), F.lit(3)), F.array(F.lit(4), F.lit(0))), texts.plain_number(F.lit(" 1,234.5 ")), texts.plain_number(F.lit("x"))) == [20, 0, 5.0, 1234.5, None]
    assert math.isclose(one(texts.normal_share(F.lit(6.0), 5.0, 2.0))[0], statistics.NormalDist(5, 2).cdf(6))
    for rgb in itertools.product((0.0, 0.25, 1.0), repeat=3):
        hsv = colorsys.rgb_to_hsv(*rgb)
        r = one(texts.rgb_to_hsv(*map(F.lit, rgb)), texts.hsv_to_rgb(*map(F.lit, hsv)))
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip([*r[0], *r[1]], [*hsv, *colorsys.hsv_to_rgb(*hsv)], strict=True)), rgb
        if rgb[0] > 0:
            break
    assert tuple(one(texts.month_range(F.lit(2024), F.lit(2)))[0]) == calendar.monthrange(2024, 2)
    assert one(texts.OPERATORS["floordiv"](F.lit(-7), F.lit(2)), texts.OPERATORS["indexOf"](F.array(F.lit(3), F.lit(4)), F.lit(4)), texts.OPERATORS["mod"](F.lit(7), F.lit(4))) == [-4, 1, 3]
    nothing = F.lit(None).cast("string")
    assert one(texts.ratio(nothing, F.lit("a")), texts.html_text(nothing), texts.wrapped(nothing), texts.shell_words(nothing)) == [None] * 4


def test_sequences(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2), ("j", 3)], "k string, v long")
    assert {tuple(r) for r in sequences.permutations(rows, ["k"], "v").collect()} == {("k", 1, 2), ("k", 2, 1)} and sequences.product(rows, rows.withColumnRenamed("v", "w"), ["k"]).count() == 10
    merged = sequences.merged([spark.createDataFrame([(1, "a"), (3, "a")], "k long, t string"), spark.createDataFrame([(1, "b"), (2, "b")], "k long, t string")], "k")
    assert [tuple(r) for r in merged.collect()] == [(1, "a"), (1, "b"), (2, "b"), (3, "a")]
    assert spark.range(1).select(sequences.folded(F.array(F.lit(2), F.lit(3)), F.lit(10), lambda a, x: a * x)).first()[0] == 60


GENERATED = "identity struct<canonical_name:string,version:string>, descriptive struct<summary:string,homepage:string,license:array<string>,categories:array<string>,maintainers:array<string>>, sources array<struct<url:string,sha256:string,filename:string,size:bigint>>, dependencies struct<build:array<string>,host:array<string>,runtime:array<string>>, build struct<system_kind:string,configure_args:array<string>,uses:array<string>>, platforms struct<include:array<string>>, conflicts array<string>, options array<string>, stub boolean"


def test_generators(spark):
    full = (("z", "1.2"), ('A "z" ${x}', "https://h", ["MIT", "X"], ["devel", "lang"], ["a@b"]), [("https://s/d/z-1.2.zip.sig", None, None, None), ("https://s/d/z-1.2.tar.gz?q", "", None, None), ("https://s/d/z-1.2.tgz", "00", None, 7)],
            (["pkgconf"], ["zlib"], ["y", "zlib"]), ("meson", ["--a"], ["ssl", "ninja"]), (["linux"],), ["w"], ["OPT"], True)
    bare = (("c", "2"), ("", "", [], [], []), [("https://s/c", "", "", 0)], ([], [], []), ("autotools", ["--b", "--c"], None), ([],), [], None, None)
    records = spark.createDataFrame([full, bare, (("n", "3"), *[None] * 8)], GENERATED)
    nix = {r["name"]: r.content for r in generators.nix_files(records).collect()}
    assert nix["z"].split("\n")[:4] == [generators.BANNER, "", "{ lib, stdenv, fetchurl, meson, ninja, pkgconf, zlib, y }:", ""]
    for line in ('  pname = "z";', '    url = "https://s/d/z-1.2.zip.sig";', "    sha256 = lib.fakeSha256;", "  nativeBuildInputs = [ meson ninja pkgconf ];", "  buildInputs = [ zlib ];", "  propagatedBuildInputs = [ y zlib ];", '    description = "A \\"z\\" \\${x}";', "    license = [ licenses.mit licenses.unfree ];", '    maintainers = [ "a@b" ];', '    platforms = [ "linux" ];'):
        assert line in nix["z"].split("\n"), line
    assert '  configureFlags = [ "--b" "--c" ];' in nix["c"] and "    platforms = platforms.all;" in nix["c"] and "  src = null; # STUB: no source URL found" in nix["n"] and nix["c"].endswith("  };\n}\n")
    port = {(r["name"], r.filename): r.content for r in generators.port_files(records).collect()}
    assert port["z", "Makefile"] == (
        f'{generators.BANNER}\n\nPORTNAME=\tz\nDISTVERSION=\t1.2\nCATEGORIES=\tdevel lang\n\nMAINTAINER=\ta@b\nCOMMENT=\tA "z" ${{x}}\nWWW=\t\thttps://h\n\nLICENSE=\tMIT UNKNOWN\n\nMASTER_SITES=\thttps://s/d/\nDISTFILES=\tz-1.2.tgz\n\nUSES=\t\tmeson ninja ssl\n\n'
        "# STUB: resolve port paths for: pkgconf\nBUILD_DEPENDS=\t# (fill in)\n\n# STUB: resolve port paths for: zlib\nLIB_DEPENDS=\t# (fill in)\n\n# STUB: resolve port paths for: y zlib\nRUN_DEPENDS=\t# (fill in)\n\nOPTIONS_DEFINE=\tOPT\n\nCONFLICTS=\tw\n\n.include <bsd.port.mk>\n"
    )
    assert port["z", "distinfo"] == "SHA256 (z-1.2.tgz) = 00\nSIZE (z-1.2.tgz) = 7\nTIMESTAMP = 0\n" and port["z", "pkg-descr"] == 'A "z" ${x}\n\nWWW: https://h\n'
    assert "GNU_CONFIGURE=\tyes\nCONFIGURE_ARGS=\t--b \\\n\t\t--c\n" in port["c", "Makefile"] and f"SHA256 (c) = {generators.NO_CHECKSUM}" in port["c", "distinfo"] and "no source URL" in port["n", "distinfo"] and port["n", "pkg-descr"] == "No description available.\n"


def test_annotations_answers_and_reports(spark):
    result = "result struct<status:string,model:string,attempted_at:string,iterations:int,final_pass_count:int,final_fail_count:int,total_invariants:int,notes:string,infeasible_reason:string,failed:map<string,struct<status:string,reason:string>>>"
    row = ("success", "m", "2026-01-01", 2, 3, 1, 4, "a: b", None, {"z.1": (None, 'no "x"')})
    frame = spark.createDataFrame([("spec: z\n", row)], f"t string, {result}").select("t", generators.annotation().alias("b"))
    once = frame.select(generators.annotated(F.col("t"), F.col("b")).alias("t"), "b")
    twice = once.select("t", generators.annotated(F.col("t"), F.col("b")).alias("refused"), generators.annotated(F.col("t"), F.col("b"), overwrite=True).alias("again")).first()
    assert twice.refused is None and twice.again == twice.t and twice.t.startswith("spec: z\n\n# ──") and '  notes: "a: b"\n  infeasible_reason: null\n  invariant_annotations:\n    z.1:\n      status: failed\n      reason: "no \\"x\\""\n' in twice.t
    answers = ["x <file name=\"a.py\"><content>\n\nA\n</content></file> <file name='b'><content>B</content></file> ```py c.py\nC\n```", "```python d/e.py\nE\n```\n```\n# f.js\nF\n```\n```\nno name\n```", "nothing"]
    assert [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").orderBy("i").select(generators.answer_files(F.col("a"))).collect()] == [{"a.py": "A", "b": "B"}, {"d/e.py": "E", "f.js": "# f.js\nF"}, {}]
    assert list(spark.range(1).select(generators.invariant_line(F.lit("i"), F.lit("k"), F.lit("x" * 70)), generators.invariant_line(F.lit("i"), F.lit(None).cast("string"), F.lit(""))).first()) == [f"i  →  '{'x' * 60}'  [k]", "i  [?]"]
    assert [r.value for r in generators.markdown(spark.createDataFrame([("b|", 1), ("a", None)], "n string, v int")).collect()] == ["| n | v |", "|---|---|", "| a |  |", "| b\\| | 1 |"]


def test_extraction_of_candidates(spark):
    schema = "identity struct<canonical_name:string,ecosystem:string,version:string>, descriptive struct<summary:string,homepage:string,license:array<string>,maintainers:array<string>,deprecated:boolean>, sources array<struct<url:string>>, dependencies struct<build:array<string>,host:array<string>,runtime:array<string>,test:array<string>>, conflicts array<string>, platforms struct<include:array<string>,exclude:array<string>>, provenance struct<confidence:double,warnings:array<string>>, stub boolean, schema_version string, _ord long"
    a1 = (("a", "x", "1"), ("s1", None, ["MIT"], ["m", ""], None), [("u",)], (["d"], [], [], None), ["c"], (["p"], []), (0.5, None), None, "0.1", 1)
    a2 = (("a", "y", "2"), ("s2", "h", ["ISC"], None, True), None, (["e", "d"], None, ["f"], []), None, None, (0.5, ["w"]), None, "0.1", 2)
    rows = spark.createDataFrame([a1, a2, (("b", "x", "1"), *[None] * 8, 3), (("", "x", "1"), *[None] * 8, 4), ((None, "x", "1"), *[None] * 8, 5)], schema)
    ranking = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("none", 9.0)], "name string, score double")
    got = {r["name"]: r for r in merge.extracted(rows, ranking, specs=spark.createDataFrame([("a", "p.json")], "name string, path string")).collect()}
    a, b = got["a"], got["b"]
    assert sorted(got) == ["a", "b"] and (a.summary, a.score, a.ecosystems, a.build_deps, a.maintainers, a.sources, a.deprecated_in, a.behavioral_spec, float(a.confidence_avg)) == ("s1", 2.0, ["x", "y"], ["d", "e"], ["m"], ["u"], ["y"], "p.json", 0.5)
    assert a.notes == ["version skew: x=1, y=2", "y has 2 more dep(s) than x", "deprecated in: y"] and (b.summary, b.license, b.notes, b.behavioral_spec) == ("", [], ["version agreement: all ecosystems at '1'"], None)
    assert [r["name"] for r in merge.extracted(rows, ranking, top=1).collect()] == [] and {r["name"] for r in merge.extracted(rows, ranking, top=2).collect()} == {"a"}
    bulk, stub = ({r["name"]: r for r in f(rows).collect()} for f in (merge.bulk_merged, merge.stubs))
    assert sorted(bulk) == ["a", "b"] and (bulk["a"]._ord, bulk["a"].dependencies.build, bulk["a"].dependencies.runtime, bulk["a"].descriptive.maintainers, bulk["a"].merged_from, [s.url for s in bulk["a"].sources]) == (1, ["d", "e"], ["f"], ["m", ""], ["x", "y"], ["u"])
    assert (stub["a"].stub, stub["a"].schema_version, stub["a"].provenance.warnings, stub["b"].conflicts) == (True, merge.SCHEMA_VERSION, [merge.STUB_WARNING], []) and merge.extracted(rows.limit(0)).count() == 0


def test_names_of_few_and_of_many_records_merge_alike(spark, monkeypatch):
    """By arrays where names have few records (no row an element, so the plan explodes nothing), by elements where they have many."""
    schema = "identity struct<canonical_name:string,ecosystem:string,version:string>, descriptive struct<summary:string,homepage:string,license:array<string>,maintainers:array<string>,deprecated:boolean>, sources array<struct<url:string,sha:string>>, dependencies struct<build:array<string>,host:array<string>,runtime:array<string>,test:array<string>>, conflicts array<string>, platforms struct<include:array<string>,exclude:array<string>>, provenance struct<confidence:double,warnings:array<string>>, stub boolean, schema_version string, _ord long"
    texts = lambda i, p: None if i % 7 == 0 else [f"{p}{i % 5}", "" if i % 3 else None, f"{p}{i % 4}", f"{p}{i % 5}"]
    sources = lambda i: None if i % 6 == 5 else [(None, str(i)), (f"u{i % 3}", str(i)), (f"u{i % 4}", "x")][i % 2 :]
    row = lambda i: ((f"n{i % 9 if i % 2 else 0}", ["x", "y", ""][i % 3], "1"), (f"s{i}", None, texts(i, "L"), texts(i + 1, "m"), i % 5 == 0), sources(i), (texts(i, "b"), texts(i + 2, "h"), None, []), texts(i + 3, "c"), (texts(i, "p"), None), (i * 7 % 10 / 10, None), None, "0.1", i * 37 % 101)
    rows = spark.createDataFrame([*map(row, range(90)), (("alone", "x", "1"), *[None] * 8, 200)], schema)
    found = []
    for many in (100, 9):
        monkeypatch.setattr(merge, "MANY", many)
        frames = [f(rows) for f in (merge.bulk_merged, merge.stubs, merge.extracted)]
        found.append([sorted((str(r.asDict(True)) for r in f.collect())) for f in frames])
        assert ("Generate" in frames[0]._jdf.queryExecution().optimizedPlan().toString()) == (many < 100)
    assert found[0] == found[1] and [len(f) for f in found[0]] == [10, 10, 10]


def test_fan_in_reads_and_sorts_lines_once(spark, tmp_path):
    """Lines are neither joined to themselves nor put together in fewer tasks than there are shuffle partitions."""
    lines = [(1, 1, "O"), (1, 1, "F"), (1, 2, "O"), (2, 1, "O"), (2, 1, "O"), (3, 1, "O"), (4, 2, "F"), (None, 1, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 30), (2, 1)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = registry.QUERIES["fanin_rank"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<l_orderkey") == 1 and "REPARTITION_BY_NUM" in plan
    assert [tuple(r) for r in found.collect()] == [(1, 3, "F,O", "F=1,O=2", True)]


def test_small_operators(spark, tmp_path):
    names = spark.createDataFrame([("z_extra001_a",), ("z_extra001_b",), ("z_extra02",), ("z_extra010",)], "name string")
    assert sorted(tuple(r) for r in audit.numbered_waves(names).collect()) == [(1, "z_extra001_a,z_extra001_b"), (10, "z_extra010")]
    assert audit.next_wave(spark.createDataFrame([("a", "complete", 1), ("b", "partial", 2), ("c", "pending", 3)], "wave string, status string, ordinal int")).first().wave == "b"
    assert [r["name"] for r in rank.ranked(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "name string, score double"), top=2).collect()] == ["c", "a"]
    assert audit.allowed(spark.createDataFrame([("a", "verified"), ("b", "pending")], "name string, status string")).count() == 1
    with pytest.raises(ValueError):
        audit.in_waves(names, spark.range(audit.MOST_WAVES + 1), F.lit(True))
    log = spark.createDataFrame([("a", "nix", True, None), ("b", "nix", False, "e")], "canonical_name string, driver string, success boolean, error string")
    records.append_log(log, str(tmp_path / "log"))
    records.append_log(log.limit(1), str(tmp_path / "log"))
    assert records.read_log(spark, str(tmp_path / "log")).count() == 3 and tuple(audit.build_summary(log).first()) == (2, 1, 1, "b")
    (tmp_path / "names.txt").write_text("# c\n a # x\n\nb\n")
    assert sorted(r["name"] for r in records.names_file(spark, str(tmp_path / "names.txt")).collect()) == ["a", "b"]
    snapshot = spark.createDataFrame([(("x",),), (("x",),), (("y",),)], "identity struct<ecosystem:string>")
    records.write_manifest(snapshot, str(tmp_path / "manifest"))
    assert {(r.ecosystem, r.n) for r in spark.read.json(str(tmp_path / "manifest")).collect()} == {("x", 2), ("y", 1)}
    r = records.sniff_specs(spark.createDataFrame([("p", 'spec: z\nbackend: node(x)\ndocs: "https://d"\ntable t:\n  function: f\n  rows:\n    - [a]\n    - [b]\n')], "_path string, value string")).first()
    assert (r.spec, r.backend, r.docs, r.n_invariants) == ("z", "node(x)", "https://d", 3)
    assert [x.k for x in validate.missing_targets(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, f string"), "f", spark.createDataFrame([("a",)], "path string")).collect()] == [2]
    roots = spark.createDataFrame([("p", "os"), ("p", "bad"), ("p", "new")], "package string, root string")
    one = lambda v: spark.createDataFrame([(v,)], "root string")
    assert {(x.root, x.reason) for x in validate.banned_imports(roots, one("os"), one("bad")).collect()} == {("bad", "banned"), ("new", "not verified")}


def test_taint_of_a_star_in_rows_of_its_nodes(spark):
    """10^5 roots at one hub with a long way to one copyleft node: a row a node, whatever they reach."""
    star = spark.range(100_000).selectExpr("id + 1000 AS src", "0L AS dst").union(spark.range(6).selectExpr("id AS src", "id + 1 AS dst"))
    near = closure.distances(star, spark.createDataFrame([(6,)], "node long"))
    assert near.count() == 100_006 and near.agg(F.max("steps")).first()[0] == 7
    got = closure.tainted(star, star.select(F.col("src").alias("root")), spark.createDataFrame([(6,), (1005,)], "node long"), 6)
    assert {r.is_tainted: r["count"] for r in got.groupBy("is_tainted").count().collect()} == {True: 6, False: 100_000}
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, None), (None, 1), (5, 4)], "src long, dst long")
    got = closure.tainted(loop, loop.select(F.col("src").alias("root")), spark.createDataFrame([(1,), (3,), (4,)], "node long"))
    assert {r.root: r.steps for r in got.collect()} == {1: 2, 2: 1, 3: 1, 4: None, 5: 1, None: None}


def test_taint_counts_what_is_reached(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (4,), (5,)], "root long")
    got = closure.tainted(edges, roots, spark.createDataFrame([(4,)], "node long"), counted=True)
    assert {r.root: (r.is_tainted, r.steps, r.n_reached) for r in got.collect()} == {1: (True, 2, 3), 4: (False, None, 1), 5: (False, None, 0)}


def test_specifications_are_read_once_by_all_cores(spark):
    one = spark.createDataFrame([(f"f{i}", f"spec: s{i}\nconstants: {{g: {{A: {i}}}}}\n") for i in range(40)], "_path string, value string").coalesce(1)
    docs = specs.parsed(one)
    assert "Python" not in docs._jdf.queryExecution().executedPlan().toString() and len(docs.inputFiles()) > 1
    assert {(r.spec, r.value) for r in specs.constants(docs).collect()} == {(f"s{i}", str(i)) for i in range(40)}


def test_layers_of_long_paths_of_branches(spark, monkeypatch):
    import random

    monkeypatch.setattr(closure, "READY_ROUNDS", 1)
    r = random.Random(7)
    edges = [e for i in range(2, 60) for e in ((i, i - 1), (i, r.randint(0, i - 2)))] + [(1, 0)]
    edges += [e for i in range(101, 108) for e in ((i, 101 + (i - 100) % 7), (i, r.randint(0, 59)))] + [(120, 105), (120, 3), (121, 120), (122, 59), (122, 121), (123, 59), (123, 40), (130, 130), (131, 130), (131, 50), (132, 131), (132, 58)]
    want, deps = {}, {}
    for a, b in edges:
        deps.setdefault(a, set()).add(b)
        deps.setdefault(b, set())
    for _ in deps:
        want |= {k: 1 + max((want[d] for d in v), default=-1) for k, v in deps.items() if v <= want.keys()}
    got = closure.layers(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(deps) and {x.node: x.layer for x in got} == {k: want.get(k) for k in deps} and want[123] == 60 and 122 not in want


def test_names_of_a_wave_are_not_repeated_with_each(spark):
    items = spark.range(300).select(F.concat(F.lit("p"), "id").alias("spec"), F.lit("b").alias("backend"), F.lit("l").alias("backend_lang"))
    waves = spark.createDataFrame([("w", [f"p{i}" for i in range(200)] + ["p0", "none"], "b", None, ["p7"], None), ("x", ["p1"], "other", None, None, None)], "wave string, names array<string>, wave_backend string, wave_lang string, exclude array<string>, pattern string")
    got = audit.in_waves(items, waves, audit.wave_match())
    assert {(r.wave, r.spec) for r in got.collect()} == {("w", f"p{i}") for i in range(200) if i != 7} and got.count() == 199 and got.agg(F.max(F.size("names"))).first()[0] == 1


def test_issues_are_found_by_all_cores(spark):
    one = spark.range(40).coalesce(1).select("id", F.parse_json(F.lit("{}")).alias("v"))
    found = validate.issue_rows(one, ["id"], validate.record_issues("v"))
    assert one.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() > 1 and found.select("id").distinct().count() == 40


def test_ranges_of_rows_are_read_by_all_cores(spark):
    for name in ("version_ranges", "version_range", "skip_by_row"):
        assert registry.QUERIES[name](spark, str(DATA)).rdd.getNumPartitions() > 1


def test_rounds_send_no_table_by_way_of_the_driver(spark):
    at = closure.written(spark.range(5).select(F.col("id").alias("node")), "at")
    plan = spark.range(5).join(at.where("node > 1").select(F.col("node").alias("id")), "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scans_split_one_key(spark):
    """All rows in one key, many of them equal: places, sums, neighbours and runs as by a window, in blocks of a part of the rows."""
    rows = spark.range(20_000, numPartitions=4).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 5000).alias("o"), (F.col("id") % 3).alias("v")).withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else Spark makes one block of so little
    table = scan.blocks(rows, ["k"], ["o"])
    sizes = [r["count"] for r in table.groupBy("_block").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    got = scan.scanned(rows, ["k"], ["o", "v"], at="at", totals={"all": ("sum", F.col("v"))}, s=("sum", F.col("v")), m=("max", F.col("v")), x=("xor", F.col("o"))).orderBy("at").collect()
    want = sorted(((r.o, r.v is not None, r.v or 0) for r in rows.collect()))
    total = run = 0
    for i, (r, (o, known, v)) in enumerate(zip(got, want)):
        total, run = total + v, run ^ o
        assert (r["at"], r.o, r.v, r.s or 0, r.x, r["all"]) == (i + 1, o, v if known else None, total, run, sum(w for *_, w in want))
    unique = rows.withColumn("o", F.monotonically_increasing_id())
    runs = {r.run: (r.v, r.n) for r in sequences.runs(unique, ["k"], ["o"], "v").collect()}
    inner = [r.v for r in unique.orderBy("o").collect()]
    n, held = -1, {}
    for i, v in enumerate(inner):
        n += i == 0 or v != inner[i - 1]
        held[n] = (v, held.get(n, (v, 0))[1] + 1)
    assert runs == held
    pairs = {r.o: (r.v, r.next_value) for r in sequences.pairs(unique, ["k"], ["o"], "v").collect()}
    order = [r.o for r in unique.orderBy("o").collect()]
    assert pairs == {o: (inner[i], inner[i + 1]) for i, o in enumerate(order[:-1])}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_over_several_keys_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(k, o, v) for k in ("a", None, "b") for o, v in ((1, 5), (None, 2), (1, 5), (3, None))], "k string, o int, v int")
    got = sequences.accumulated(rows, ["k"], ["o"], "v").collect()
    assert sorted(((r.k or ""), r.o or 0, r.running_sum, r.running_max) for r in got) == sorted((k, o, s, m) for k in ("a", "", "b") for o, s, m in ((0, 2, 2), (1, 7, 5), (1, 12, 5), (3, 12, 5)))
    numbered = sequences.numbered(rows, [], ["k", "o"]).collect()
    assert sorted(r["at"] for r in numbered) == list(range(12)) and sequences.numbered(rows.limit(0), [], ["o"]).count() == 0
    assert sequences.pairs(rows, ["k"], ["o"], "v").count() == 9 and sequences.runs(rows.limit(0), ["k"], ["o"], "v").count() == 0


def test_statistics_without_holding_a_group(spark):
    data = {"a": [3.0, 1.0, 2.0, 2.0], "b": [5.0], "c": [None], None: [-1.0, 4.0, None], "d": [float(i % 97) for i in range(3000)]}
    rows = spark.createDataFrame([(k, v) for k, x in data.items() for v in x], "k string, v double")
    for by in (["k"], []):
        got = {r.k if by else "all": r for r in sequences.spread_statistics(rows, by, "v").collect()}
        groups = data if by else {"all": [v for x in data.values() for v in x]}
        assert got.keys() == groups.keys()
        for k, x in groups.items():
            x = [v for v in x if v is not None]
            r = got[k]
            assert r.median == (statistics.median(x) if x else None) and r["mode"] == (min(statistics.multimode(x)) if x else None)
            assert r.mean == pytest.approx(statistics.mean(x)) if x else r.mean is None
            assert r.stdev == pytest.approx(statistics.stdev(x)) if len(x) > 1 else r.stdev is None
    assert sequences.spread_statistics(rows.limit(0), ["k"], "v").count() == 0


def test_cycles_equal_definition(spark):
    import random

    for seed in (1,):
        r = random.Random(seed)
        edges = {(r.randrange(40), r.randrange(40)) for _ in range(45)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(200, 200), (200, 201), (201, 202), (300, 100), (104, 301), (301, 302)}
        reach = {n: {b for a, b in edges if a == n} for e in edges for n in e}
        for _ in reach:
            reach = {n: v.union(*(reach[m] for m in v)) for n, v in reach.items()}
        component = {n: min(m for m in v if n in reach[m]) for n, v in reach.items() if n in v}
        step = {n: min(b for a, b in edges if a == n and component.get(b) == component[n]) for n in component}
        circles = {}
        for n in component:
            path = [n]
            while step[path[-1]] not in path:
                path.append(step[path[-1]])
            ring = path[path.index(step[path[-1]]) :]
            k = ring.index(min(ring))
            circles.setdefault(component[n], []).append(ring[k:] + ring[:k])
        place = {n: i for c in circles.values() for i, n in enumerate(min(c))}
        got = closure.cycles(spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")).collect()
        assert {x.node: (x.component, x.place) for x in got} == {n: (c, place.get(n)) for n, c in component.items()}
    assert closure.cycles(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0 and closure.cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sql_cases(spark):
    t = {"t": ("id int, name string, price double", [(1, "pear", 2.5), (2, "fig", None), (3, "fig", 0.5)])}
    two = t | {"u": ("id int, n int", [(1, 4), (1, 5), (9, 6)])}
    held = [
        ("rows", "SELECT id, name FROM t", [(1, "pear"), (3, "fig"), (2, "fig")], t), ("null", "SELECT price FROM t WHERE id = 2", [(None,)], t), ("real", "SELECT price FROM t WHERE price > 1", [(2.5,)], t), ("count", "SELECT count(*) FROM t", [(3,)], t),
        ("filter", "SELECT name FROM t WHERE id >= 2 AND name = 'fig'", [("fig",), ("fig",)], t), ("empty", "SELECT id FROM e", [], {"e": ("id int", [])}), ("group", "SELECT name, count(*) FROM t GROUP BY name", [("fig", 2), ("pear", 1)], t), ("sum", "SELECT sum(price) FROM t", [(3.0,)], t),
        ("join", "SELECT t.name, u.n FROM t JOIN u USING (id)", [("pear", 5), ("pear", 4)], two), ("left", "SELECT t.id, u.n FROM t LEFT JOIN u USING (id) WHERE t.id > 1", [(2, None), (3, None)], two), ("distinct", "SELECT DISTINCT name FROM t", [("pear",), ("fig",)], t), ("nested", "SELECT name FROM t WHERE id = (SELECT max(id) FROM t)", [("fig",)], t),
        ("like", "SELECT id FROM t WHERE name LIKE 'p%'", [(1,)], t), ("case", "SELECT CASE WHEN price IS NULL THEN 'none' ELSE 'some' END FROM t WHERE id < 3", [("some",), ("none",)], t),
    ]
    cases = [sql_cases.Case(i, q, e, tables) for i, q, e, tables in held]
    bad = [sql_cases.Case("lacks", "SELECT id FROM t", [(1,)], t), sql_cases.Case("twice", "SELECT name FROM t WHERE name = 'fig'", [("fig",)], t), sql_cases.Case("broken", "SELEC", [], t), sql_cases.Case("no table", "SELECT * FROM u", [], t), sql_cases.Case("order", "SELECT id FROM t ORDER BY id DESC", [(1,), (2,), (3,)], t, True)]
    cases += [sql_cases.Case("down", "SELECT id FROM t ORDER BY id DESC", [(3,), (2,), (1,)], t, True)]
    got = {r.id: r.passed for r in sql_cases.sql_holds(spark, cases + bad).collect()}
    assert got == {c.id: True for c in cases} | {c.id: False for c in bad} and len(cases) == 15
    assert not spark.catalog.tableExists("t")

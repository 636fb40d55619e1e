"""A rule engine for records: each rule is a condition and a message, each broken one a row."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.shared import spread


@dataclass(frozen=True)
class Rule:
    """broken: a condition; null counts as not broken."""

    field: str
    level: str
    message: str
    broken: Column


def issues(rows: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """key, field, level, message of every broken rule of every row; one scan, no shuffle."""
    found = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.field).alias("field"), F.lit(r.level).alias("level"), F.lit(r.message).alias("message"))) for r in rules]
    return rows.select(*key, F.inline(F.array_compact(F.array(*found))))


def validity(rows: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """key, n_issues, valid of every row: any issue, a warning too, makes a row invalid."""
    n = F.lit(0)
    for r in rules:
        n = n + F.when(F.coalesce(r.broken, F.lit(False)), 1).otherwise(0)
    return rows.select(*key, n.cast("long").alias("n_issues"), (n == 0).alias("valid"))


#: Fixed values of the record format.
REQUIRED = ("schema_version", "identity", "descriptive", "sources", "dependencies", "build", "features", "platforms", "conflicts", "patches", "tests", "provenance", "extensions")
IDENTITY = ("canonical_name", "canonical_id", "version", "ecosystem", "ecosystem_id")
BUCKETS = ("build", "host", "runtime", "test")
KNOWN_ECOSYSTEMS = ("nixpkgs", "freebsd_ports")
KNOWN_BUILD_SYSTEMS = ("autotools", "cmake", "meson", "waf", "perl", "python", "go", "cargo", "freebsd_ports_make", "nix_derivation", "unknown")
ISSUE = "array<struct<field:string,level:string,message:string>>"


class Document:
    """Questions about a JSON document in a VARIANT column."""

    def __init__(self, column: str | Column):
        self.v = F.col(column) if isinstance(column, str) else column

    def get(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.v, f"$.{path}" if path else "$", kind)

    def there(self, path: str) -> Column:
        """Whether the field is in the document, null or not."""
        return self.get(path).isNotNull()

    def kind(self, path: str) -> Column:
        """string, boolean, number, array, object or null; SQL's null where the field is not in the document."""
        return kind_of(self.get(path))

    def items(self, path: str) -> Column:
        return F.coalesce(self.get(path, "array<variant>"), F.array().cast("array<variant>"))

    def is_no(self, path: str, kind: str) -> Column:
        return self.there(path) & (self.kind(path) != kind)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once."""
    return F.transform(F.array(value), then)[0]


def kind_of(v: Column) -> Column:
    def named(t: Column) -> Column:
        number = t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
        return F.when(t == "STRING", "string").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "BOOLEAN", "boolean").when(number, "number").otherwise("null")

    return F.when(v.isNotNull(), _let(F.schema_of_variant(v), named))


def _truthy(v: Column) -> Column:
    """Whether a value is neither missing, null, false, 0 nor empty."""
    text = F.to_json(v)
    return F.coalesce(v.isNotNull() & ~text.isin("null", "false", '""', "[]", "{}") & ~text.rlike(r"^-?0(\.0*)?$"), F.lit(False))


def _issue(field: str | Column, level: str, message: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(field).alias("field"), F.lit(level).alias("level"), lit(message).alias("message"))


def _type_name(v: Column) -> Column:
    """The name under which a value's type is reported."""
    k = kind_of(v)
    whole = F.schema_of_variant(v) == "BIGINT"
    return F.when(k == "null", "NoneType").when(k == "boolean", "bool").when(whole, "int").when(k == "number", "float").when(k == "array", "list").when(k == "object", "dict").otherwise("str")


#: A rule about one field: what is wrong (check), under which conditions, and what is then said.
RULE = "struct<section:string,field:string,check:string,kind:string,nullable:boolean,known:array<string>,level:string,message:string>"
#: A rule about the elements of a list: their kind, a field that objects must have, and what is said of others.
LIST_RULE = "struct<section:string,field:string,kind:string,lacking:string,message:string>"


def _rule(path: str, check: str, message: str, kind: str | None = None, nullable: bool = False, known: tuple[str, ...] = (), level: str = "ERROR") -> dict:
    section, _, field = path.rpartition(".")
    return {"section": section, "field": field, "check": check, "kind": kind, "nullable": nullable, "known": list(known), "level": level, "message": message}


def _record_rules(strict: bool) -> list[dict]:
    rules = [_rule(f, "missing", "required field missing") for f in REQUIRED] + [_rule("schema_version", "no_text", "must be a non-empty string")]
    rules += [_rule(f, "kind", "must be an object", "object") for f in ("identity", "descriptive", "dependencies", "build", "provenance", "platforms")]
    rules += [_rule(f, "kind", "must be an object", "object", nullable=True) for f in ("features", "extensions", "tests")]
    rules += [_rule(f"identity.{f}", "empty", "required and must be non-empty") for f in IDENTITY]
    rules += [_rule(path, "unknown", "unknown value", known=known, level="WARN") for path, known in (("identity.ecosystem", KNOWN_ECOSYSTEMS), ("build.system_kind", KNOWN_BUILD_SYSTEMS))]
    lists = ("descriptive.license", "descriptive.categories", "descriptive.maintainers", "provenance.unmapped", "provenance.warnings", "platforms.include", "platforms.exclude", "conflicts", "sources", "patches")
    rules += [_rule(f, "kind", "must be an array", "array") for f in lists]
    rules += [_rule("descriptive.deprecated", "kind", "must be a boolean", "boolean"), _rule("descriptive.expiration_date", "kind", "must be a string", "string"), _rule("behavioral_spec", "kind", "must be a string path", "string", nullable=True)]
    rules += [_rule(f"dependencies.{b}", "missing", "required field missing") for b in BUCKETS] + [_rule(f"dependencies.{b}", "kind", "must be an array", "array") for b in BUCKETS]
    rules += [_rule("provenance.confidence", "no_number", "must be a number"), _rule("provenance.confidence", "out_of_range", "out of range [0, 1]")]
    if strict:
        rules += [_rule(f"descriptive.{f}", "empty", f"empty — consider adding {what}", level="WARN") for f, what in (("summary", "a description"), ("homepage", "a homepage URL"))]
        rules += [_rule(f"provenance.{f}", "any", what, level="WARN") for f, what in (("unmapped", "unmapped field(s)"), ("warnings", "warning(s)"))]
    return rules


def _list_rules() -> list[dict]:
    texts = [*(f"dependencies.{b}" for b in BUCKETS), "conflicts"]
    made = [(path, "string", None, None) for path in texts] + [("sources", "object", "type", "must be an object"), ("patches", "object", "path", "must be an object")]
    return [{"section": p.rpartition(".")[0], "field": p.rpartition(".")[2], "kind": kind, "lacking": lacking, "message": message} for p, kind, lacking, message in made]


def _as_data(rules: list[dict], kind: str) -> Column:
    """Rules as one constant array."""
    return F.from_json(F.lit(json.dumps(rules)), f"array<{kind}>")


#: Sections of a record, whose fields rules ask for.
SECTIONS = ("identity", "descriptive", "dependencies", "build", "provenance", "platforms")


def _members(v: Column) -> Column:
    """An object's members; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _held(document: Column) -> Column:
    """A record as struct<top, under>: its members, and those of its sections by the section's name."""
    sections = F.transform(F.array(*map(F.lit, SECTIONS)), lambda s: F.struct(s.alias("key"), s.alias("value")))
    return _let(_members(document), lambda top: F.struct(top.alias("top"), F.map_from_entries(F.transform(sections, lambda s: F.struct(s["key"], _members(F.try_element_at(top, s["key"]))))).alias("under")))


def _value(held: Column, rule: Column) -> Column:
    """What a rule asks about; null where the document has no such field."""
    return F.when(rule["section"] == "", F.try_element_at(held["top"], rule["field"])).otherwise(F.try_element_at(F.try_element_at(held["under"], rule["section"]), rule["field"]))


def _at(rule: Column) -> Column:
    return F.when(rule["section"] == "", rule["field"]).otherwise(F.concat_ws(".", rule["section"], rule["field"]))


def _list_of(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def record_issues(document: str | Column, strict: bool = False) -> Column:
    """Issues of a record in a VARIANT column: missing fields, wrong types, bad elements by index, unknown values; strict: also what is poor.

    An array<struct<field, level, message>> in one expression; a field that is missing is not of a wrong type besides. The rules
    are data: the expression, and the time to compile it, is that of one rule, whatever their number."""
    d = F.col(document) if isinstance(document, str) else document

    def broken(held: Column, rule: Column) -> Column:
        def judged(x: Column) -> Column:
            v, kind = x["v"], x["kind"]
            text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
            there = v.isNotNull()
            section = F.try_element_at(held["top"], rule["section"])
            in_object = (rule["section"] == "") | section.isNull() | (kind_of(section) == "object")
            other = there & (kind != rule["kind"]) & ~(rule["nullable"] & (kind == "null"))
            number = kind.isin("number", "boolean")
            n = F.size(_list_of(v))
            check = rule["check"]
            wrong = (
                F.when(check == "missing", ~there & in_object).when(check == "kind", other).when(check == "empty", in_object & ~_truthy(v)).when(check == "unknown", _truthy(v) & ~F.array_contains(rule["known"], text))
                .when(check == "no_text", ~there | (kind != "string") | (text == "")).when(check == "no_number", there & ~number & (kind != "null")).when(check == "out_of_range", there & number & ~F.try_variant_get(v, "$", "double").between(0, 1)).when(check == "any", n > 0)
            )
            said = F.when(check == "unknown", F.concat(rule["message"], F.lit(" '"), text, F.lit("'"))).when(check == "any", F.concat_ws(" ", n.cast("string"), rule["message"])).otherwise(rule["message"])
            return F.when(F.coalesce(wrong, F.lit(False)), F.struct(_at(rule).alias("field"), rule["level"].alias("level"), said.alias("message")))

        return _let(_value(held, rule), lambda v: _let(F.struct(v.alias("v"), kind_of(v).alias("kind")), judged))

    def elements(held: Column, rule: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            lacks = F.when(rule["lacking"] == "type", F.try_variant_get(x, "$.type", "variant").isNull()).when(rule["lacking"] == "path", F.try_variant_get(x, "$.path", "variant").isNull())
            message = F.when(F.coalesce(kind_of(x), F.lit("null")) != rule["kind"], F.coalesce(rule["message"], F.concat(F.lit("must be a string, got "), _type_name(x)))).when(lacks, F.concat(F.lit("missing required field '"), rule["lacking"], F.lit("'")))
            return F.when(message.isNotNull(), F.struct(F.concat(_at(rule), F.lit("["), i.cast("string"), F.lit("]")).alias("field"), F.lit("ERROR").alias("level"), message.alias("message")))

        return F.array_compact(F.transform(_list_of(_value(held, rule)), of))

    def all_of(held: Column) -> Column:
        one = F.array_compact(F.transform(_as_data(_record_rules(strict), RULE), lambda rule: broken(held, rule)))
        return F.concat(one, F.flatten(F.transform(_as_data(_list_rules(), LIST_RULE), lambda rule: elements(held, rule))))

    return _let(_held(d), all_of)


#: Fixed values of compiled specifications: required fields by scope, and kinds of invariants. Missing fields are reported in
#: the order of the alphabet, so those of an invariant stand in it.
SPEC_FIELDS = {
    "": ("schema_version", "identity", "provenance", "library", "constants", "types", "functions", "invariants", "wire_formats", "error_model"), "identity": ("canonical_name", "spec_for_versions"),
    "provenance": ("derived_from", "not_derived_from"), "library": ("soname_patterns",), "error_model": ("error_codes", "return_code_semantics"),
}
INVARIANT_FIELDS = ("category", "description", "id", "kind", "spec")
KNOWN_KINDS = (
    "constant_eq", "call_eq", "call_returns", "version_prefix", "roundtrip", "wire_bytes", "error_on_bad_input", "incremental_eq_oneshot", "call_ge", "hash_known_vector", "hash_incremental", "hash_object_attr",
    "python_set_contains", "hash_digest_consistency", "hash_copy_independence", "hash_api_equivalence", "python_call_eq", "python_call_raises", "python_encode_decode_roundtrip", "python_struct_roundtrip",
    "python_sqlite_roundtrip", "cli_exits_with", "cli_stdout_eq", "cli_stdout_contains", "cli_stdout_matches", "cli_stderr_contains", "node_module_call_eq", "node_constructor_call_eq", "node_factory_call_eq",
    "node_chain_eq", "node_property_eq", "node_sandbox_chain_eq", "ctypes_chain_eq", "ctypes_sandbox_chain_eq", "lz4_roundtrip", "pcre2_match",
)


def spec_issues(document: str | Column) -> Column:
    """Errors of a compiled specification in a VARIANT column, as record_issues(): required fields, arrays, repeated ids, unknown kinds, as many arg_types as args."""
    d = Document(document)
    one = [(~d.there(f) if not scope else (d.kind(scope) == "object") & ~d.there(f"{scope}.{f}"), _issue(scope or f, "ERROR", f"missing required field '{f}'")) for scope, fields in SPEC_FIELDS.items() for f in fields]
    one += [(d.is_no(f"provenance.{f}", "array") & (d.kind(f"provenance.{f}") != "null"), _issue(f"provenance.{f}", "ERROR", "must be an array")) for f in SPEC_FIELDS["provenance"]]
    one += [(d.is_no("invariants", "array") & (d.kind("invariants") != "null"), _issue("invariants", "ERROR", "must be an array"))]
    items = d.items("invariants")
    ids = F.transform(items, lambda x, i: F.coalesce(F.try_variant_get(x, "$.id", "string"), F.concat(F.lit("<index "), i.cast("string"), F.lit(">"))))

    def of(p: Column, i: Column) -> Column:
        x, own = p["x"], p["id"]
        at = F.concat(F.lit("invariants["), i.cast("string"), F.lit("]"))
        get = lambda path, kind="variant": F.try_variant_get(x, f"$.{path}", kind)
        lacking = [F.when(get(f).isNull(), _issue(at, "ERROR", f"missing required field '{f}'")) for f in INVARIANT_FIELDS]
        size = lambda f: F.size(get(f"spec.{f}", "array<variant>"))
        is_list = lambda f: kind_of(get(f"spec.{f}")) == "array"
        lengths = F.concat(F.lit("arg_types length ("), size("arg_types").cast("string"), F.lit(") does not match args length ("), size("args").cast("string"), F.lit(")"))
        found = [
            *lacking, F.when(p["again"], _issue(at, "ERROR", F.concat(F.lit("duplicate id '"), own, F.lit("'")))),
            F.when((kind_of(get("kind")) != "null") & ~F.coalesce(get("kind", "string"), F.lit("")).isin(*KNOWN_KINDS), _issue(at, "ERROR", F.concat(F.lit("unknown kind '"), get("kind", "string"), F.lit("'")))),
            F.when(is_list("args") & is_list("arg_types") & (size("args") != size("arg_types")), _issue(at, "ERROR", lengths)),
        ]
        return F.when(kind_of(x) == "object", F.array_compact(F.array(*found))).otherwise(F.array(_issue(at, "ERROR", "must be an object")))

    # whether an id stands earlier too, by a sort of (id, place)
    places = F.array_sort(F.transform(ids, lambda k, i: F.struct(k.alias("id"), (i + 1).alias("at"))))
    above = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(0).alias("at"))), places)
    marked = F.transform(F.arrays_zip(places.alias("own"), above.alias("above")), lambda z: F.struct(z["own"]["at"].alias("at"), z["own"]["id"].alias("id"), z["own"]["id"].eqNullSafe(z["above"]["id"]).alias("again")))
    order = F.array_sort(F.filter(marked, lambda m: m["at"].isNotNull()))
    rows = F.zip_with(items, order, lambda x, m: F.struct(x.alias("x"), m["id"].alias("id"), m["again"].alias("again")))
    top = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), issue) for broken, issue in one]))
    return F.concat(top, F.flatten(F.transform(rows, of)))


def issue_rows(rows: DataFrame, key: list[str], found: Column) -> DataFrame:
    """key, field, level, message of every issue; rows are dealt to all cores first."""
    return spread(rows).select(*key, F.inline(found))


def file_validity(texts: DataFrame, found: Column | None = None, strict: bool = False) -> DataFrame:
    """_path, n_issues, n_errors, valid of documents as texts(_path, value): what is no JSON object is one error; any issue, a warning too, makes a file invalid."""
    read = texts.select("_path", F.try_parse_json("value").alias("v"))
    whole = kind_of(F.col("v")) == "object"
    bad = F.array(_issue("", "ERROR", "no JSON object"))
    of = F.when(F.coalesce(whole, F.lit(False)), record_issues("v", strict) if found is None else found).otherwise(bad)
    judged = read.select("_path", of.alias("found"))
    return judged.select("_path", F.size("found").cast("long").alias("n_issues"), F.size(F.filter("found", lambda x: x["level"] == "ERROR")).cast("long").alias("n_errors"), (F.size("found") == 0).alias("valid"))


#: Fixed value: a note that says a specification exposes another module's name.
EXPOSES = r'"Expose\s+\w+.*?:\s*\w+\.\w+'


def lint(specs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """spec, level, message of specification sources (value) by their text: a rust_module backend in one that is not among known(spec) is
    forbidden; a clean-room one with a note that it exposes another module's name is suspect. Texts without a name are left out."""
    named = specs.select(F.regexp_extract("value", r"(?m)^spec:\s+(\S+)", 1).alias("spec"), "value").where("spec <> ''")
    new = named if known is None else named.join(known.select("spec").distinct(), "spec", "left_anti")
    bad = new.where(F.col("value").rlike(r"(?m)^backend:\s+rust_module\s*\(")).select("spec", F.lit("ERROR").alias("level"), F.lit("new specification with a rust_module backend").alias("message"))
    shown = named.where(F.col("value").rlike(r"(?m)^backend:\s+(python|node)_cleanroom") & F.col("value").rlike(EXPOSES))
    return bad.unionByName(shown.select("spec", F.lit("WARN").alias("level"), F.lit("notes say that it exposes another module's name").alias("message")))


def repeated_ids(rows: DataFrame, scope: list[str], key: str) -> DataFrame:
    """scope, key, extra: second and further occurrences of a key within its scope."""
    return rows.groupBy(*scope, key).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def missing_targets(rows: DataFrame, reference: str, files: DataFrame, path: str = "path") -> DataFrame:
    """rows whose non-null reference names no file."""
    return rows.where(F.col(reference).isNotNull()).join(files.select(F.col(path).alias(reference)).distinct(), reference, "left_anti")


def banned_imports(imports: DataFrame, allowed: DataFrame, banned: DataFrame) -> DataFrame:
    """package, root, reason of imports(package, root): banned roots, and roots that allowed(root) lacks."""
    named = imports.select("package", "root").distinct()
    bad = named.join(banned.select("root").distinct(), "root", "left_semi").withColumn("reason", F.lit("banned"))
    rest = named.join(banned.select("root").distinct(), "root", "left_anti").join(allowed.select("root").distinct(), "root", "left_anti").withColumn("reason", F.lit("not verified"))
    return bad.unionByName(rest).select("package", "root", "reason")


#: Modules in which the standard library's own implementation of another one lies.
BACKDOORS = {
    "ast": ("_ast",), "bisect": ("_bisect",), "bz2": ("_bz2",), "collections": ("_collections", "_collections_abc"), "csv": ("_csv",), "ctypes": ("_ctypes",), "decimal": ("_decimal",), "elementtree": ("_elementtree",),
    "hashlib": ("_hashlib", "_blake2", "_md5", "_sha1", "_sha2", "_sha3"), "heapq": ("_heapq",), "io": ("_io",), "lzma": ("_lzma",), "pickle": ("_pickle",), "socket": ("_socket",), "sqlite3": ("_sqlite3",), "ssl": ("_ssl",), "struct": ("_struct",), "zstd": ("_zstd",),
}


def backdoors(spark: SparkSession) -> DataFrame:
    """blocks, root: the table of BACKDOORS."""
    return spark.createDataFrame([(k, r) for k, roots in BACKDOORS.items() for r in roots], "blocks string, root string")


def import_policy(imports: DataFrame, blocked: DataFrame, hidden: DataFrame, standard: DataFrame, verified: DataFrame, own: str) -> DataFrame:
    """package, root, reason of imports(package, root) that a rewritten package may not make.

    blocked(package, blocks): what the package stands in for, and may not import (blocked); hidden(blocks, root): nor may it what that
    is made of (backdoor). Roots that begin with `own` must be among verified(root) (not verified), all others among standard(root)
    (not standard). The first that holds is the reason; __future__ is always allowed. All by equi-joins."""
    root = F.substring_index("blocks", ".", 1)
    named = imports.select("package", "root").distinct().where("root <> '__future__'").join(blocked.select("package", "blocks").distinct(), "package", "left")
    doors = hidden.select(F.col("blocks").alias("_door"), "root").distinct().withColumn("_hidden", F.lit(True))
    by = lambda c, flag: named.join(doors, (F.col(c) == F.col("_door")) & (named["root"] == doors["root"])).select("package", named["root"], F.lit(True).alias(flag)).distinct()
    named = named.withColumn("_top", root)
    whole, top = by("blocks", "_whole"), by("_top", "_part")
    flag = lambda df, n: df.select("root").distinct().withColumn(n, F.lit(True))
    all_of = named.join(whole, ["package", "root"], "left").join(top, ["package", "root"], "left").join(flag(standard, "_standard"), "root", "left").join(flag(verified, "_verified"), "root", "left")
    mine = F.startswith("root", F.lit(own))
    reason = (
        F.when((F.col("root") == F.col("blocks")) | (F.col("root") == F.col("_top")), "blocked").when(F.col("_whole") | F.col("_part"), "backdoor")
        .when(mine & F.col("_verified").isNull(), "not verified").when(~mine & F.col("_standard").isNull(), "not standard")
    )
    return all_of.select("package", "root", reason.alias("reason")).where("reason IS NOT NULL").distinct()

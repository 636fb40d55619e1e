"""Specifications in YAML with tagged values, read into documents, single invariants and tables of cases."""

from __future__ import annotations

import ast
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # only reading YAML needs it
    yaml = None

from lodemill.operators import invariants
from lodemill.shared import spread, written

#: Tags of the sources, and the types they stand for in documents.
TAGS = {"!b64": "bytes_b64", "!hex": "bytes_hex", "!ascii": "bytes_ascii", "!tuple": "tuple"}
#: Keys of a table that say how its rows become invariants; other keys are fields that all rows share.
TABLE_HEAD = ("kind", "category", "id_prefix", "id_from", "describe", "rfc", "skip_if", "columns", "rows")
#: Keys of an invariant that describe it and are no part of its body.
INVARIANT_HEAD = ("kind", "description", "category", "rfc", "skip_if", "call", "eq", "raises")
_PARSED = "doc string, problem string"
_CALLED = "body string, problem string"


def _loader() -> type:
    if yaml is None:
        raise ImportError("reading specifications needs PyYAML")

    class Loader(yaml.SafeLoader):
        pass

    def typed(loader, node):
        value = loader.construct_sequence(node, deep=True) if node.tag == "!tuple" else loader.construct_scalar(node)
        return {"type": TAGS[node.tag], "value": value}

    for tag in TAGS:
        Loader.add_constructor(tag, typed)
    return Loader


def _text(x: Any) -> str | None:
    """Texts as they are, other values as JSON, null as null."""
    return x if x is None or isinstance(x, str) else json.dumps(x, default=str)


def _parse(texts: pd.Series) -> pd.DataFrame:
    loader, out = _loader(), []
    for t in texts:
        try:
            doc = yaml.load(t or "", Loader=loader)  # noqa: S506, a safe loader with four tags more
        except (yaml.YAMLError, ValueError) as e:
            out.append((None, f"no YAML: {type(e).__name__}"))
            continue
        if not isinstance(doc, dict):
            out.append((None, "no mapping"))
        elif not doc.get("spec"):
            out.append((None, "no spec"))
        else:
            out.append((json.dumps({str(k): v for k, v in doc.items()}, default=str), None))
    return pd.DataFrame(out, columns=["doc", "problem"])


def _literal(node: ast.expr) -> Any:
    """A literal's value; tuples as typed values, as a tag would give."""
    match node:
        case ast.Constant(value=None | bool() | int() | float() | str() as v):
            return v
        case ast.Constant(value=bytes() as v):
            return {"type": "bytes_hex", "value": v.hex()}
        case ast.List(elts=items):
            return [_literal(x) for x in items]
        case ast.Tuple(elts=items):
            return {"type": "tuple", "value": [_literal(x) for x in items]}
        case ast.Dict(keys=keys, values=values) if all(keys):
            return {_literal(k): _literal(v) for k, v in zip(keys, values, strict=True)}
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as v)):
            return -v
    raise ValueError("not a literal")


def _name(node: ast.expr) -> str | None:
    """A name with dots, or None for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    head = _name(node.value) if isinstance(node, ast.Attribute) else None
    return head and f"{head}.{node.attr}"


def _steps(node: ast.expr) -> tuple[dict, list[tuple[str, list]]]:
    """The innermost call, and what follows it as (name, arguments), first to last."""
    match node:
        case ast.Call(func=f, args=args, keywords=named):
            values = [_literal(a) for a in args]
            if fn := _name(f):
                return {"function": fn, "args": values} | ({"kwargs": {k.arg: _literal(k.value) for k in named}} if named else {}), []
            if isinstance(f, ast.Attribute):
                call, after = _steps(f.value)
                return call, [*after, (f.attr, values)]
        case ast.Attribute(value=inner, attr=attr):
            call, after = _steps(inner)
            return call, [*after, (attr, [])]
    raise ValueError("not a call")


def call_body(expression: str) -> dict:
    """A call written as Python text, with at most two attributes or methods after it, as fields; arguments are literals, nothing is run."""
    call, after = _steps(ast.parse(expression.strip(), mode="eval").body)
    if len(after) > 2:
        raise ValueError("more than two steps follow the call")
    for key, (name, args) in zip(("method", "method_chain"), after):  # noqa: B905, at most as many steps as keys
        call[key] = name
        if args and key == "method":
            call["method_args"] = args
    return call


def _called(expressions: pd.Series) -> pd.DataFrame:
    out = []
    for e in expressions:
        try:
            out.append((None if e is None else json.dumps(call_body(e)), None))
        except (ValueError, SyntaxError, RecursionError, TypeError):
            out.append((None, "call can't be read"))
    return pd.DataFrame(out, columns=["body", "problem"])


def documents(spark: SparkSession, roots: list[str], pattern: str = "*.yaml") -> DataFrame:
    """parsed() of every file below the roots; Spark's reader lists and reads them."""
    files = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return parsed(files.select(F.col("_metadata.file_path").alias("_path"), "value"))


def parsed(texts: DataFrame) -> DataFrame:
    """_path, spec, doc (JSON text, keys in the source's order), problem of texts(_path, value).

    Tagged values are {"type", "value"}. problem says why a text is no specification (no YAML, no mapping, no
    name under spec; null texts are no mapping); then spec and doc are null. Texts are dealt to all cores and read once, into
    the shared folder: what is made of documents reads them up to seven times.
    """
    read = spread(texts.select("_path", F.col("value").cast("string").alias("value"))).select("_path", F.pandas_udf(_parse, _PARSED)("value").alias("p"))
    return written(read.select("_path", F.get_json_object("p.doc", "$.spec").alias("spec"), F.col("p.doc").alias("doc"), F.col("p.problem").alias("problem")), "specs")


_BLOCKS = "array<struct<what:string,label:string,body:string,head:map<string,string>,call:string,shared:map<string,string>,columns:array<string>,rows:array<struct<cells:array<string>,overrides:map<string,string>>>>>"


def _block(key: str, block: Any) -> dict | None:
    what, _, label = key.partition(" ")
    if what not in ("invariant", "table"):
        return None
    out = dict.fromkeys(("what", "label", "body", "head", "call", "shared", "columns", "rows")) | {"what": what, "label": label.strip()}
    if not isinstance(block, dict):
        return out
    named = TABLE_HEAD if what == "table" else INVARIANT_HEAD
    out["head"] = {k: _text(block[k]) for k in named if k in block and k not in ("columns", "rows", "eq", "raises")}
    rest = {str(k): v for k, v in block.items() if k not in named}
    if what == "invariant":
        wanted = {n: block[k] for k, n in (("eq", "expected"), ("raises", "expected_exception")) if k in block}
        out["body"] = json.dumps(dict([*wanted.items()][:1]) if "call" in block else rest, default=str)
        out["call"] = _text(block.get("call"))
        return out
    columns = [_text(c) for c in block.get("columns") or []]
    out["shared"], out["columns"], out["rows"] = {k: json.dumps(v, default=str) for k, v in rest.items()}, columns, []
    for row in block.get("rows") or []:
        cells = list(row) if isinstance(row, list) else [row]
        own = cells.pop() if len(cells) == len(columns) + 1 and isinstance(cells[-1], dict) else None
        out["rows"].append({"cells": [json.dumps(c, default=str) for c in cells], "overrides": own and {str(k): json.dumps(v, default=str) for k, v in own.items()}})
    return out


def _blocks(docs: pd.Series) -> pd.Series:
    return docs.map(lambda doc: [b for k, v in json.loads(doc or "{}").items() if (b := _block(k, v))])


def blocks(docs: DataFrame) -> DataFrame:
    """_path, spec, ord and the parts of every block "invariant x" and "table x" of documents, in the source's order."""
    good = docs.where(F.col("doc").isNotNull())
    return good.select("_path", "spec", F.posexplode(F.pandas_udf(_blocks, _BLOCKS)("doc")).alias("ord", "b")).select("_path", "spec", "ord", "b.*")


def _merged(a: Column, b: Column) -> Column:
    """Two JSON objects in one, as text."""
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    return F.concat(F.lit("{"), F.concat_ws(", ", F.nullif(inner(a), F.lit("")), F.nullif(inner(b), F.lit(""))), F.lit("}"))


def single_invariants(docs: DataFrame) -> DataFrame:
    """spec, ord, id, kind, description, category, rfc_reference, skip_if, fields (VARIANT), problem of blocks "invariant x".

    A block with a call is of kind python_call_eq (with eq) or python_call_raises and has the call's parts and the
    expected value as fields; others name their kind. problem says why a block can't be used; then fields is null.
    """
    one = blocks(docs).where("what = 'invariant'")
    head = lambda k: F.try_element_at("head", F.lit(k))
    by_call = F.coalesce(F.map_contains_key("head", "call"), F.lit(False))
    wants = F.coalesce(F.get(F.json_object_keys("body"), F.lit(0)), F.lit(""))
    one = one.select("*", by_call.alias("by_call"), wants.alias("wants"), F.pandas_udf(_called, _CALLED)("call").alias("called"))
    kind = F.when(F.col("by_call"), F.when(F.col("wants") == "expected", "python_call_eq").when(F.col("wants") == "expected_exception", "python_call_raises")).otherwise(F.nullif(head("kind"), F.lit("")))
    problem = F.when(F.col("head").isNull(), "no mapping").when(F.col("by_call") & kind.isNull(), "call without eq or raises").when(F.col("by_call"), F.coalesce("called.problem", F.when(F.col("called.body").isNull(), "call can't be read"))).when(kind.isNull(), "no kind")
    one = one.select("*", kind.alias("kind"), problem.alias("problem"))
    # a description given as null or empty counts only beside a call
    given = F.when(F.col("by_call"), head("description")).otherwise(F.nullif(head("description"), F.lit("")))
    body = F.when(F.col("problem").isNull(), F.when(F.col("by_call"), _merged(F.col("called.body"), F.col("body"))).otherwise(F.col("body")))
    return one.select(
        "spec", "ord", F.col("label").alias("id"), "kind", F.coalesce(given, F.concat_ws(": ", "kind", "label")).alias("description"), F.coalesce(head("category"), F.lit("general")).alias("category"),
        head("rfc").alias("rfc_reference"), head("skip_if").alias("skip_if"), F.parse_json(body).alias("fields"), "problem",
    )


def case_tables(docs: DataFrame) -> DataFrame:
    """Blocks "table x" in invariants.TABLE_SCHEMA, for invariants.expand(..., json=True): cells, shared fields and overrides are JSON values.

    A mapping after a row's cells holds fields that replace others.
    """
    head = [F.try_element_at("head", F.lit(k)).alias(k) for k in ("kind", "category", "id_prefix", "id_from", "describe", "rfc", "skip_if")]
    return blocks(docs).where("what = 'table'").select("spec", "label", *head, "shared", "columns", "rows")


def all_invariants(docs: DataFrame) -> DataFrame:
    """Single ones and those of tables: spec, id, kind, description, category, rfc_reference, skip_if, fields (VARIANT), problem."""
    names = ["spec", "id", "kind", "description", "category", "rfc_reference", "skip_if", "fields", "problem"]
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1), F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    from_tables = invariants.expand(case_tables(docs), json=True).withColumn("fields", F.parse_json(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))))
    return single_invariants(docs).select(names).unionByName(from_tables.select(names))


#: Backends by what stands before their parenthesis: the library's backend and command, and the key of its name.
BACKENDS = {
    "python_module": ("python_module", None), "rust_module": ("rust_module", None), "python_cleanroom": ("python_cleanroom", None), "node_cleanroom": ("node_cleanroom", None), "cli": ("cli", None), "node": ("cli", "node"),
}


def headers(docs: DataFrame) -> DataFrame:
    """spec, spec_for_versions, api_header, docs, rfcs, backend, command, module_name, soname_patterns, esm, backend_lang, cleanroom_path,
    blocks, derived_from, not_derived_from of documents: their header with its defaults, one row each."""
    get = lambda k: F.get_json_object("doc", f"$.{k}")
    texts = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>"))
    given = F.coalesce(get("backend"), F.lit(""))
    kind, name = F.regexp_extract(given, r"(?s)^(\w+)\((.*)\)$", 1), F.regexp_extract(given, r"(?s)^(\w+)\((.*)\)$", 2)
    backend, command = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (b, c) in BACKENDS.items():
        backend, command = F.when(kind == k, b).otherwise(backend), F.when(kind == k, F.lit(c).cast("string")).otherwise(command)
    command = F.when(kind == "cli", name).otherwise(command)
    clean = kind.isin("python_cleanroom", "node_cleanroom")
    header = F.when(F.startswith(given, F.lit("python_module")) | F.startswith(given, F.lit("rust_module")), "N/A — Python module").otherwise("")
    rfc = r"(?i)^(RFC\s*\S+)\s*[—–-]\s*(.*)"
    named = lambda r, t: F.struct(r.alias("rfc"), t.alias("title"))
    plain = lambda x: F.when(F.regexp_like(x, F.lit(rfc)), named(F.trim(F.regexp_extract(x, rfc, 1)), F.trim(F.regexp_extract(x, rfc, 2)))).otherwise(named(x, F.lit("")))
    rfcs = F.transform(texts("rfcs"), lambda x: F.when(F.startswith(x, F.lit("{")), named(F.get_json_object(x, "$.rfc"), F.coalesce(F.get_json_object(x, "$.title"), F.lit("")))).otherwise(plain(x)))
    return docs.where(F.col("doc").isNotNull()).select(
        "_path", "spec", F.coalesce(get("version"), F.lit(">=0")).alias("spec_for_versions"), F.coalesce(get("api_header"), header).alias("api_header"), get("docs").alias("docs"), rfcs.alias("rfcs"), backend.alias("backend"), command.alias("command"),
        F.when(~kind.isin("", "cli", "ctypes"), name).alias("module_name"), F.when(kind == "ctypes", F.array(name)).otherwise(F.array().cast("array<string>")).alias("soname_patterns"), F.coalesce((kind == "node") & (get("esm") == "true"), F.lit(False)).alias("esm"),
        F.when(clean, kind).alias("backend_lang"), F.when(clean, F.concat(F.lit("cleanroom/"), F.substring_index(kind, "_", 1), F.lit("/"), name)).alias("cleanroom_path"), texts("blocks").alias("blocks"),
        texts("provenance.derived_from").alias("derived_from"), texts("provenance.not_derived_from").alias("not_derived_from"),
    )


def _members(doc: str | Column, path: str) -> Column:
    """A JSON object's members as a map of JSON texts (texts without quotes); empty where there is none."""
    found = F.get_json_object(doc, path)
    return F.coalesce(F.from_json(F.when(F.startswith(found, F.lit("{")), found), "map<string,string>"), F.expr("map()").cast("map<string,string>"))


def constants(docs: DataFrame) -> DataFrame:
    """spec, group, name, value, description of all constants: groups are lists of {name, value} or mappings of names to a value or to {value, ...};
    entries without a name or a value are left out. Values that are no texts are JSON texts."""
    groups = docs.where(F.col("doc").isNotNull()).select("spec", F.explode(_members("doc", "$.constants")).alias("group", "held"))
    listed = F.from_json(F.when(F.startswith("held", F.lit("[")), F.col("held")), "array<string>")
    one = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("of"))
    entries = F.concat(
        F.coalesce(F.transform(listed, lambda e: F.struct(F.get_json_object(e, "$.name").alias("name"), e.alias("of"))), F.slice(F.array(one), 1, 0)),
        F.transform(F.map_entries(F.coalesce(F.from_json(F.when(F.startswith("held", F.lit("{")), F.col("held")), "map<string,string>"), F.expr("map()").cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("of"))),
    )
    rows = groups.select("spec", "group", F.inline(entries))
    is_object = F.startswith("of", F.lit("{"))
    value = F.when(is_object, F.get_json_object("of", "$.value")).otherwise(F.col("of"))
    return rows.select("spec", "group", "name", value.alias("value"), F.when(is_object, F.get_json_object("of", "$.description")).alias("description")).where("name IS NOT NULL AND value IS NOT NULL")


def functions(docs: DataFrame) -> DataFrame:
    """spec, name, parameters (array of struct<name, of>, of: a JSON text), return_type, preconditions, postconditions, description of all functions."""
    rows = docs.where(F.col("doc").isNotNull()).select("spec", F.explode(_members("doc", "$.functions")).alias("name", "of"))
    get = lambda k: F.get_json_object("of", f"$.{k}")
    named = F.transform(F.map_entries(_members("of", "$.params")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("of")))
    listed = F.transform(F.from_json(F.when(F.startswith(get("params"), F.lit("[")), get("params")), "array<string>"), lambda e: F.struct(F.get_json_object(e, "$.name").alias("name"), e.alias("of")))
    return rows.select("spec", "name", F.coalesce(listed, named).alias("parameters"), get("returns").alias("return_type"), get("pre").alias("preconditions"), get("post").alias("postconditions"), get("description").alias("description"))


#: What the short form of an error model stands for.
PYTHON_ERRORS = ("Python exceptions; raises on bad inputs; each call is stateless", "N/A — each call is stateless")


def _json_at(path: str, *kinds: str) -> Column:
    """What lies at a path of doc, as JSON text (keys sorted), if it is of one of these kinds; null elsewhere."""
    found = F.try_variant_get(F.try_parse_json("doc"), path, "variant")
    kind = F.regexp_extract(F.schema_of_variant(found), "^[A-Z]+", 0)
    return F.when(kind.isin(*kinds), F.to_json(found)) if kinds else F.to_json(found)


def error_models(docs: DataFrame) -> DataFrame:
    """spec, return_code_semantics, stream_error_field, error_stickiness, error_codes (array of struct<name, of>), codes (all of every code, a JSON list) of
    documents, with defaults; short forms are spelled out. Codes by name get it as a field beside their own ones, which may replace it."""
    given = F.get_json_object("doc", "$.error_model")
    whole = F.coalesce(F.startswith(given, F.lit("{")), F.lit(False))
    short = given == "python_exceptions"
    get = lambda k, default: F.when(whole, F.coalesce(F.get_json_object(given, f"$.{k}"), F.lit(default))).otherwise(default)
    semantics = F.when(short, PYTHON_ERRORS[0]).when(whole | given.isNull(), get("semantics", "")).otherwise(given)
    as_list, as_object = _json_at("$.error_model.codes", "ARRAY"), _json_at("$.error_model.codes", "OBJECT")
    listed = F.transform(F.from_json(as_list, "array<string>"), lambda e: F.struct(F.get_json_object(e, "$.name").alias("name"), e.alias("of")))
    members = F.map_entries(F.from_json(as_object, "map<string,string>"))
    named = F.transform(members, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("of")))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    is_object = lambda e: F.coalesce(F.startswith(e["value"], F.lit("{")) & F.is_variant_null(F.try_parse_json(e["value"])).eqNullSafe(False), F.lit(False))
    plain = lambda e: F.concat(F.lit('{"name":'), quoted(e["key"]), F.lit("}"))
    has_name = lambda e: F.get_json_object(e["value"], "$.name").isNotNull()
    full = F.transform(members, lambda e: F.when(is_object(e), F.when(has_name(e), e["value"]).otherwise(_merged(plain(e), e["value"]))).otherwise(plain(e)))
    codes = F.when(whole, F.coalesce(as_list, F.concat(F.lit("["), F.array_join(full, ","), F.lit("]"))))
    return docs.where(F.col("doc").isNotNull()).select(
        "spec", semantics.alias("return_code_semantics"), get("stderr", "null").alias("stream_error_field"), F.when(short, PYTHON_ERRORS[1]).otherwise(get("stickiness", "N/A")).alias("error_stickiness"),
        F.when(whole, F.coalesce(listed, named)).alias("error_codes"), F.coalesce(codes, F.lit("[]")).alias("codes"),
    )


def layouts(docs: DataFrame) -> DataFrame:
    """spec, types, wire_formats of documents as JSON texts: types as they are written (empty or false ones are {}), wire formats if they are a mapping (else {})."""
    types = _json_at("$.types")
    nothing = types.isin("null", "false", "0", '""', "[]", "{}")
    return docs.where(F.col("doc").isNotNull()).select("spec", F.coalesce(F.when(~nothing, types), F.lit("{}")).alias("types"), F.coalesce(_json_at("$.wire_formats", "OBJECT"), F.lit("{}")).alias("wire_formats"))


def compiled(docs: DataFrame) -> DataFrame:
    """spec, v (VARIANT) of each document as a compiled specification: header, constants, types, wire formats, functions, error model and all usable invariants in one object.

    A specification's parts meet in one row, as the result does."""
    h = headers(docs).drop("_path")
    library = F.struct("backend", "command", "module_name", "soname_patterns", F.when(F.col("esm"), F.lit(True)).alias("esm"))
    identity = F.struct(F.col("spec").alias("canonical_name"), "spec_for_versions", "api_header", F.col("docs").alias("public_docs_url"), F.when(F.size("rfcs") > 0, F.col("rfcs")).alias("rfc_references"))
    heads = h.select("spec", identity.alias("identity"), library.alias("library"), F.struct("derived_from", "not_derived_from").alias("provenance"), "backend_lang", "cleanroom_path", F.when(F.size("blocks") > 0, F.col("blocks")).alias("blocks"))
    model = F.to_json(F.struct("return_code_semantics", "stream_error_field", "error_stickiness"))
    errors = error_models(docs).select("spec", F.concat(F.regexp_replace(model, r"\}$", ""), F.lit(', "error_codes": '), "codes", F.lit("}")).alias("error_model")).join(layouts(docs), "spec")
    every = all_invariants(docs).where("problem IS NULL")
    one = F.struct("id", "description", "category", "kind", "rfc_reference", "skip_if", F.col("fields").alias("spec"))
    held = every.groupBy("spec").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.to_json(one).alias("j")))), lambda x: x["j"]).alias("invariants"))
    grouped = constants(docs).groupBy("spec", "group").agg(F.array_sort(F.collect_list(F.struct("name", "value", "description"))).alias("c")).groupBy("spec").agg(F.map_from_entries(F.collect_list(F.struct("group", "c"))).alias("constants"))
    called = functions(docs).groupBy("spec").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("parameters", "return_type", "preconditions", "postconditions", "description")))).alias("functions"))
    both = heads.join(errors, "spec").join(held, "spec", "left").join(grouped, "spec", "left").join(called, "spec", "left")
    rest = F.to_json(F.struct(F.lit("0.2").alias("schema_version"), "identity", "provenance", "library", F.coalesce("constants", F.expr("map()").cast(grouped.schema["constants"].dataType)).alias("constants"), F.coalesce("functions", F.expr("map()").cast(called.schema["functions"].dataType)).alias("functions"), "backend_lang", "cleanroom_path", "blocks"))
    texts = [x for n in ("error_model", "types", "wire_formats") for x in (F.lit(f', "{n}": '), F.col(n))]
    lists = F.concat(*texts, F.lit(', "invariants": ['), F.coalesce(F.array_join("invariants", ", "), F.lit("")), F.lit("]}"))
    return both.select("spec", F.parse_json(F.concat(F.regexp_replace(rest, r"\}$", ""), lists)).alias("v"))

"""Tables of test cases expanded into invariants, typed values, and conditions under which an invariant is skipped."""

from __future__ import annotations

import ast
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions import packages

#: One table of cases: what its header says, the columns' names, and its rows of as many cells, with fields that replace the header's.
TABLE_SCHEMA = (
    "spec string, label string, kind string, category string, id_prefix string, id_from string, describe string, rfc string, skip_if string, "
    "shared map<string,string>, columns array<string>, rows array<struct<cells:array<string>,overrides:map<string,string>>>"
)
#: Columns of a table that describe the invariant and are no fields of its body.
ABOUT = ("id", "description", "rfc", "skip_if", "category")
_NONE = "map()"


def _over(first: Column, then: Column) -> Column:
    """Both maps; of a key in both the second one's value."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(then, k)), then)


def _given(x: Column) -> Column:
    """Null where empty."""
    return F.when(x != "", x)


def _filled(template: Column, fields: Column) -> Column:
    """A template's {name} marks replaced by fields, all at once; {{ and }} stand for braces."""
    parts = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{\w+\}|[^{}]+|[{}])"), 1)

    def put(p: Column) -> Column:
        name = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.when(p.isin("{{", "}}"), F.substring(p, 1, 1)).when(p.rlike(r"^\{\w+\}$"), F.coalesce(F.try_element_at(fields, name), F.lit("None"))).otherwise(p)

    return F.array_join(F.transform(parts, put), "")


def _shown(value: Column) -> Column:
    """A JSON value as it reads in a text."""
    plain = F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")
    return F.when(value == "true", "True").when(value == "false", "False").when(value == "null", "None").otherwise(plain)


def expand(tables: DataFrame, json: bool = False) -> DataFrame:
    """One invariant per row of each table (TABLE_SCHEMA), in one scan without a shuffle.

    id is spec, prefix and row id (the column id_from, else the column id), joined by dots. A row's own
    description, category, rfc and skip_if go before the table's; its overrides before its fields, these
    before the shared ones. A kwargs cell without a value is no field. Of repeated column names the last holds.
    problem says why a row can't be used (null if it can): then id and fields are null. A table without rows
    gives none; `row` counts from 0. json: cells, shared fields and overrides are JSON values, and so are the fields.
    """
    plain = (lambda v: F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]")) if json else lambda v: v
    named = tables.select("*", F.posexplode("rows").alias("row", "given"))
    cells, columns = F.col("given.cells"), F.col("columns")
    fits = F.coalesce(F.size(cells) == F.size(columns), F.lit(False))
    last = lambda k, i: ~F.array_contains(F.slice(columns, i + 2, F.greatest(F.size(columns), F.lit(1))), k)
    pairs = F.when(fits, F.filter(F.transform(F.filter(columns, last), lambda k: F.struct(k.alias("key"), F.element_at(cells, F.size(columns) - F.array_position(F.reverse(columns), k).cast("int") + 1).alias("value"))), lambda p: p["key"].isNotNull()))
    named = named.withColumn("own", F.map_from_entries(pairs))
    own, get = F.col("own"), lambda k: plain(F.try_element_at(F.col("own"), F.lit(k)))
    by = _given(F.col("id_from"))
    row_id = F.when(by.isNotNull(), plain(F.try_element_at(own, by))).otherwise(get("id"))
    problem = F.when(~F.coalesce(F.size(columns) > 0, F.lit(False)), "no columns").when(~fits, "cells and columns differ in number").when(row_id.isNull(), "no id")
    named = named.select("*", problem.alias("problem"), F.when(problem.isNull(), F.concat_ws(".", "spec", _given(F.col("id_prefix")), row_id)).alias("id"))
    body = F.map_filter(own, lambda k, v: ~(k.isin(*ABOUT) | ((k == "kwargs") & (v.isNull() | (F.lit(json) & (v == "null"))))))
    none = F.expr(_NONE).cast("map<string,string>")
    body = _over(_over(F.coalesce("shared", none), body), F.coalesce("given.overrides", none))
    describe = F.when(_given(F.col("describe")).isNotNull(), _filled(F.col("describe"), F.transform_values(own, lambda k, v: _shown(v)) if json else own)).otherwise(F.concat_ws(": ", "kind", "id"))
    return named.select(
        "spec", "label", "row", "id", "kind", F.when(F.col("problem").isNull(), F.coalesce(get("description"), describe)).alias("description"),
        F.coalesce(get("category"), _given(F.col("category")), F.lit("general")).alias("category"),
        F.coalesce(get("rfc"), _given(F.col("rfc"))).alias("rfc_reference"), F.coalesce(get("skip_if"), _given(F.col("skip_if"))).alias("skip_if"),
        F.when(F.col("problem").isNull(), body).alias("fields"), "problem",
    )


def typed_bytes(kind: Column, value: Column) -> Column:
    """Bytes of a value tagged bytes_b64, bytes_hex or bytes_ascii; null with another tag or a value that is none; empty for null."""
    text = F.coalesce(value, F.lit(""))
    ascii_only = F.when(~text.rlike(r"[^\x00-\x7F]"), F.encode(text, "UTF-8"))
    return F.when(kind == "bytes_b64", F.try_to_binary(text, F.lit("base64"))).when(kind == "bytes_hex", F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("hex"))).when(kind == "bytes_ascii", ascii_only)


def canonical(value: Column) -> Column:
    """A typed value (VARIANT) as a JSON text that is equal for equal values: {"type", "value"} is resolved by its type, other values stand for themselves.

    Bytes become {"bytes": hex}, tuples lists, whole floats the integer (1 and 1.0 are equal); null where a value is none of its type."""
    get = lambda c, kind="variant": F.try_variant_get(value, f"$.{c}", kind)
    kind, inner, text = get("type", "string"), get("value"), get("value", "string")
    typed = F.startswith(F.schema_of_variant(value), F.lit("OBJECT")) & kind.isNotNull()
    as_json = lambda v: F.regexp_replace(F.coalesce(F.to_json(v), F.lit("null")), r"^(-?[0-9]+)\.0+$", "$1")
    quoted = lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1)
    data = typed_bytes(kind, text)
    number = text.try_cast("double")
    truth = ~F.coalesce(F.to_json(inner), F.lit("null")).isin("null", "false", "0", '""', "[]", "{}")
    of = F.when(kind.startswith("bytes_"), F.when(data.isNotNull(), F.concat(F.lit('{"bytes":"'), F.lower(F.hex(data)), F.lit('"}'))))
    of = of.when(kind == "str", quoted(F.coalesce(text, F.lit("")))).when(kind == "int", text.try_cast("double").cast("bigint").cast("string")).when(kind == "float", F.regexp_replace(number.cast("string"), r"^(-?[0-9]+)\.0$", "$1"))
    of = of.when(kind == "bool", F.when(truth, "true").otherwise("false")).when(kind == "null", "null").when(kind == "tuple", F.coalesce(F.to_json(inner), F.lit("[]"))).when(kind == "json", as_json(inner))
    return F.when(value.isNotNull(), F.when(F.coalesce(typed, F.lit(False)) & kind.isin(*TYPES), of).otherwise(as_json(value)))


#: Types of typed values.
TYPES = ("bytes_b64", "bytes_hex", "bytes_ascii", "tuple", "str", "int", "float", "bool", "null", "json")
#: What conditions are made of.
NAMES, FUNCTION = ("lib_version", "platform"), "semver_satisfies"
COMPARISONS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
#: A condition as the steps that work it out: each takes truths from the end of what there is so far and puts its own there.
STEPS = "array<struct<op:string,left:string,left_name:string,right:string,right_name:string>>"


def _operand(node: ast.AST) -> tuple[str | None, str | None]:
    """(text, name) of a text or a name."""
    match node:
        case ast.Constant(value=str() as v):
            return v, None
        case ast.Name(id=name) if name in NAMES:
            return None, name
    raise ValueError("no text")


def _steps(node: ast.AST) -> list[tuple]:
    nothing = (None, None, None, None)
    match node:
        case ast.Constant(value=bool() as v):
            return [("true" if v else "false", *nothing)]
        case ast.Constant(value=str()) | ast.Name():
            return [("filled", *_operand(node), None, None)]
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return [*_steps(x), ("not", *nothing)]
        case ast.BoolOp(op=op, values=[first, *others]):
            return [*_steps(first), *[s for x in others for s in [*_steps(x), ("and" if isinstance(op, ast.And) else "or", *nothing)]]]
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in COMPARISONS:
            try:
                return [(COMPARISONS[type(op)], *_operand(a), *_operand(b))]
            except ValueError:
                if type(op) in (ast.Eq, ast.NotEq):
                    return [*_steps(a), *_steps(b), ("same" if isinstance(op, ast.Eq) else "differ", *nothing)]
                raise
        case ast.Call(func=ast.Name(id=name), args=[version, wanted], keywords=[]) if name == FUNCTION:
            return [("fits", *_operand(version), *_operand(wanted))]
    raise ValueError("not allowed in a condition")


@lru_cache(maxsize=10_000)
def condition_steps(expression: str) -> list[tuple] | None:
    """A condition's steps; None if it can't be read. The text is parsed, never run."""
    try:
        return _steps(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def skipped(skip_if: Column, version: Column, platform: Column) -> Column:
    """Whether each row's own condition holds: lib_version, platform, texts, comparisons, and/or/not, semver_satisfies(v, "constraint").

    Every row may have a condition of its own: a small parser turns it into steps, which column expressions work out. What
    is null or can't be read never skips, nor does an unknown version or a constraint that can't be read."""
    names = ["op", "left", "left_name", "right", "right_name"]

    def parsed(texts: pa.Array) -> pa.Array:
        found = [None if t is None else condition_steps(t) for t in texts.to_pylist()]
        return pa.array([None if f is None else [dict(zip(names, s, strict=True)) for s in f] for f in found], pa.list_(pa.struct([(n, pa.string()) for n in names])))

    steps = F.arrow_udf(parsed, STEPS)(skip_if)
    return F.coalesce(_worked_out(steps, F.coalesce(version, F.lit("")), F.coalesce(platform, F.lit(""))), F.lit(False))


def _worked_out(steps: Column, version: Column, platform: Column) -> Column:
    def step(truths: Column, s: Column) -> Column:
        value = lambda side: F.when(s[f"{side}_name"] == "lib_version", version).when(s[f"{side}_name"] == "platform", platform).otherwise(s[side])
        a, b, op, n = value("left"), value("right"), s["op"], F.size(truths)
        one, two = F.get(truths, n - 1), F.get(truths, n - 2)
        fits = packages.is_version(a) & (F.trim(b) != "") & packages.satisfies(a, b)
        own = (
            F.when(op == "fits", F.coalesce(fits, F.lit(False))).when(op == "==", a == b).when(op == "!=", a != b).when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == ">=", a >= b).when(op == "filled", a != "")
            .when(op == "not", ~one).when(op == "and", two & one).when(op == "or", two | one).when(op == "same", two == one).when(op == "differ", two != one).otherwise(op == "true")
        )
        taken = F.when(op == "not", 1).when(op.isin("and", "or", "same", "differ"), 2).otherwise(0)
        return F.concat(F.slice(truths, F.lit(1), n - taken), F.array(own))

    return F.aggregate(steps, F.array().cast("array<boolean>"), step, lambda truths: F.get(truths, F.lit(0)))

"""What Python and Node sources import."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _roots(text: str | None) -> list[str] | None:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return None
    nodes = list(ast.walk(tree))
    named = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
    named += [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module and not n.level]
    return sorted({x.partition(".")[0] for x in named} - {"__future__"})


def _all_roots(texts: pd.Series) -> pd.Series:
    return texts.map(_roots)


def python_roots(text: Column) -> Column:
    """Top-level packages that a Python source imports, sorted; relative imports and __future__ apart; null if it can't be parsed."""
    return F.pandas_udf(_all_roots, "array<string>")(F.coalesce(text, F.lit("")))


def node_requests(text: Column) -> Column:
    """Modules that a Node source asks for by require, import or from, sorted."""
    name = r"""['"]([^'"]+)['"]"""
    found = [F.regexp_extract_all(text, F.lit(rf"\b{p}"), 1) for p in (rf"(?:require|import)\s*\(\s*{name}\s*\)", rf"(?:from|import)\s*{name}")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def node_root(request: Column) -> Column:
    """A request's package: without node: and without what follows the first slash."""
    return F.substring_index(F.regexp_replace(request, "^node:", ""), "/", 1)

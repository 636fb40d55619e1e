"""What has a specification and what lacks one, and how many vectors are described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spec_names(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Names under which a package's specification may stand: its own and its alias, each also with _ for -."""
    alias = F.lit(None).cast("string")
    for old, new in (aliases or {}).items():
        alias = F.when(name == old, F.lit(new)).otherwise(alias)
    plain = F.array_compact(F.array(name, alias))
    return F.array_distinct(F.concat(plain, F.transform(plain, lambda x: F.translate(x, "-", "_"))))


def covered(items: DataFrame, specs: DataFrame, key: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """items with covered: whether specs(key) has any of the names an item may have.

    Items that are their own only name join directly; only those with other names too are tried by each of them."""
    names = specs.select(F.col(key).cast("string").alias("_name")).distinct().withColumn("_there", F.lit(True))
    tried = items.withColumn("_names", spec_names(F.col(key).cast("string"), aliases))
    plain = tried.where(F.size("_names") <= 1).withColumn("_name", F.get("_names", 0)).join(names, "_name", "left")
    others = tried.where(F.size("_names") > 1)
    found = others.select(F.col(key).alias("_item"), F.explode("_names").alias("_name")).distinct().join(names, "_name").groupBy("_item").agg(F.lit(True).alias("_there"))
    several = others.join(found, F.col(key) == F.col("_item"), "left")
    held = lambda d: d.select(*items.columns, F.coalesce("_there", F.lit(False)).alias("covered"))
    return held(plain).unionByName(held(several))


def coverage_totals(found: DataFrame) -> DataFrame:
    """One row over covered()'s rows: total, covered, gap and the covered share in tenths of a percent (half up; 0 of none)."""
    n, good = F.count("*"), F.count_if("covered")
    return found.agg(n.alias("total"), good.alias("covered"), (n - good).alias("gap"), F.when(n > 0, F.floor((good * 2000 + n) / (2 * n))).otherwise(0).cast("long").alias("tenths"))


def by_score(extractions: DataFrame, top: int = 0, score: str = "score", file: str = "file") -> DataFrame:
    """Extractions from the highest score down (none counts as 0), files breaking ties; the first `top` of them, or all (0)."""
    out = extractions.orderBy(F.coalesce(F.col(score), F.lit(0)).desc(), F.col(file).asc())
    return out.limit(top) if top else out


def below_score(coverage: DataFrame, min_score: float) -> DataFrame:
    """Specifications of vector_coverage() whose share of described vectors is below a percentage; the totals are left out."""
    return coverage.where((F.col("level") == 1) & (F.col("tenths") < F.lit(min_score) * 10))


def orphans(specs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """specs whose key no item has."""
    return specs.join(items.select(key), key, "left_anti")


def vector_coverage(invariants: DataFrame, described: Column, spec: str = "spec", category: str = "category") -> DataFrame:
    """spec, category, total, n_described, tenths (of a percent, half up) by category, by spec (category null) and in all (both null): one ROLLUP."""
    rows = invariants.select(F.col(spec).alias("spec"), F.col(category).alias("category"), described.alias("described"))
    counted = rows.rollup("spec", "category").agg(F.count("*").alias("total"), F.count_if("described").alias("n_described"), F.grouping_id().alias("level"))
    return counted.withColumn("tenths", F.floor((F.col("n_described") * 2000 + F.col("total")) / (2 * F.col("total"))).cast("long"))


def search(specs: DataFrame, term: str, columns: list[str], backend: str | None = None, verified: DataFrame | None = None, key: str = "name") -> DataFrame:
    """specs that hold a term (case does not count) in any column, of a backend, in a table of verified names."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False))
    out = specs.where(hit)
    if backend:
        out = out.where(F.col("backend") == backend)
    return out if verified is None else out.join(verified.select(key).distinct(), key, "left_semi")

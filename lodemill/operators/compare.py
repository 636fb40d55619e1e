"""Differences of two snapshots, two runs, or two sets of invariants: full outer joins on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_name(records: DataFrame, side: str) -> DataFrame:
    """Of each name, its ecosystems and, of each ecosystem, the version of the last record (by ord)."""
    last = records.where(F.col("name").isNotNull()).groupBy("name", "ecosystem").agg(F.max_by("version", "ord").alias("version"))
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("ecosystem", "version"))))
    return last.groupBy("name").agg(held.alias(f"{side}_versions"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change of records(name, ecosystem, version, ord): added, removed, version_changed, ecosystem_changed, unchanged.

    Versions are compared in the ecosystems that both sides have; a changed version goes before changed ecosystems.
    """
    both = _by_name(before, "old").join(_by_name(after, "new"), "name", "full_outer")
    old, new = F.col("old_versions"), F.col("new_versions")
    common = F.array_intersect(F.map_keys(old), F.map_keys(new))
    moved = F.exists(common, lambda e: ~F.element_at(old, e).eqNullSafe(F.element_at(new, e)))
    same = F.array_sort(F.map_keys(old)) == F.array_sort(F.map_keys(new))
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(moved, "version_changed").when(~same, "ecosystem_changed").otherwise("unchanged")
    return both.select("name", change.alias("change"))


def change_counts(diff: DataFrame) -> DataFrame:
    """One row of counts over snapshot_diff()'s rows."""
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "version_changed", "ecosystem_changed", "unchanged")])


def baseline_diff(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change of results(keys, passed): regression, fix, added, removed; keys without a change are left out."""
    old = baseline.select(*keys, F.col("passed").alias("was"), F.lit(1).alias("in_old"))
    new = current.select(*keys, F.col("passed").alias("is"), F.lit(1).alias("in_new"))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was") & ~F.col("is"), "regression").when(~F.col("was") & F.col("is"), "fix")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def compare_sets(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, side: only_a, only_b, both or, where both values are known and differ, mismatch."""
    x = a.select(key, F.col(value).alias("va"), F.lit(1).alias("in_a"))
    y = b.select(key, F.col(value).alias("vb"), F.lit(1).alias("in_b"))
    both = x.join(y, key, "full_outer")
    side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("va") != F.col("vb"), "mismatch").otherwise("both")
    return both.select(key, side.alias("side"))


def multiset(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """key, n of two bags by their counts: sum, difference, union (the larger) or intersection (the smaller); only positive ones."""
    x, y = (t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((a, "na"), (b, "nb")))
    both = x.join(y, key, "full_outer").select(key, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    n: dict[str, Column] = {"sum": na + nb, "difference": na - nb, "union": F.greatest(na, nb), "intersection": F.least(na, nb)}
    return both.select(key, n[how].alias("n")).where("n > 0")

"""Ranking of names by their records, and of dependencies by the records that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_score(confidence: Column, has_tests: Column, n_deps: Column, n_patches: Column) -> Column:
    """Worth of one record: 50 x confidence, 15 for tests, 20 less a point a dependency (not below 0), less 2 a patch."""
    return confidence * 50 + F.when(has_tests, 15).otherwise(0) + F.greatest(F.lit(0), 20 - n_deps) - 2 * n_patches


def candidates(records: DataFrame, a: str, b: str, bonus: int = 25) -> DataFrame:
    """One row a name of records(name, ecosystem, version, score, confidence, has_tests, n_patches).

    The mean score, `bonus` more where ecosystems a and b both have the name; mean confidence, whether any record
    has tests, all patches, and the sorted distinct ecosystems and versions. One shuffle on the name.
    """
    dual = F.coalesce(F.bool_or(F.col("ecosystem") == a), F.lit(False)) & F.coalesce(F.bool_or(F.col("ecosystem") == b), F.lit(False))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    per = records.groupBy("name").agg(
        F.count("*").alias("n_records"), F.sum("score").alias("total_score"), F.avg("score").alias("mean_score"), dual.alias("dual"), F.avg("confidence").alias("avg_confidence"),
        F.coalesce(F.bool_or("has_tests"), F.lit(False)).alias("has_any_tests"), F.sum("n_patches").alias("total_patch_count"), listed("ecosystem"), listed("version"),
    )
    return per.withColumn("score", F.col("mean_score") + F.when(F.col("dual"), bonus).otherwise(0))


def ranked(rows: DataFrame, by: str = "score", name: str = "name", top: int = 0) -> DataFrame:
    """Rows from the highest down, names breaking ties; the first `top` of them, or all (0)."""
    out = rows.orderBy(F.col(by).desc_nulls_last(), F.col(name).asc_nulls_last())
    return out.limit(top) if top else out


def fan_in(edges: DataFrame, known: DataFrame | None = None, min_refs: int = 0) -> DataFrame:
    """How many records need each dependency.

    edges(record, ecosystem, dep): a record counts once for a dependency however many buckets name it. Returns
    dep, ref_count, ecosystems, refs_by_ecosystem ("eco=n", sorted) and, with known(name), in_snapshot, with
    known(name, ecosystem) also known_ecosystems. Two
    partial aggregations; a dependency that very many records share is a row a task.
    """
    once = edges.where(F.col("dep").isNotNull() & (F.col("dep") != F.lit("").cast(edges.schema["dep"].dataType) if edges.schema["dep"].dataType.simpleString() == "string" else F.col("dep").isNotNull())).dropDuplicates(["record", "dep"])
    by_eco = once.groupBy("dep", "ecosystem").agg(F.count("*").alias("refs"))
    per = by_eco.groupBy("dep").agg(
        F.sum("refs").alias("ref_count"), F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "ecosystem", F.col("refs").cast("string")))), ",").alias("refs_by_ecosystem"),
    )
    out = per.where(F.col("ref_count") >= min_refs)
    if known is None:
        return out
    by_name = known_ecosystems(known) if "ecosystem" in known.columns else known.select("name").distinct()
    names = by_name.withColumnRenamed("name", "dep").withColumn("in_snapshot", F.lit(True))
    return out.join(names, "dep", "left").withColumn("in_snapshot", F.coalesce("in_snapshot", F.lit(False)))


def known_ecosystems(known: DataFrame) -> DataFrame:
    """name, known_ecosystems (sorted, comma-joined) of known(name, ecosystem)."""
    return known.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("known_ecosystems"))


def dependency_edges(records: DataFrame, buckets: tuple[str, ...] = ("build", "host", "runtime", "test")) -> DataFrame:
    """(record, ecosystem, bucket, dep) of nested records: one row a distinct dependency of a bucket."""
    of = F.col("dependencies")
    named = lambda b: lambda d: F.struct(F.lit(b).alias("bucket"), d.alias("dep"))
    entries = F.concat(*[F.transform(F.coalesce(of[b], F.array().cast("array<string>")), named(b)) for b in buckets])
    return records.select(F.col("_path").alias("record"), F.col("identity.ecosystem").alias("ecosystem"), F.inline(F.array_distinct(entries)))


def take_ranked(candidates: DataFrame, ecosystems: list[str], min_refs: int, count: int) -> DataFrame:
    """The first `count` of fan_in() rows in the snapshot, with enough references, that any of the ecosystems has."""
    wanted = F.arrays_overlap(F.split("ecosystems", ","), F.array(*map(F.lit, ecosystems)))
    return ranked(candidates.where((F.col("ref_count") >= min_refs) & F.col("in_snapshot") & wanted), "ref_count", "dep", count)

"""Filling records with what was evaluated elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEXTS = "array<string>"
#: Notes on records whose dependencies are not known, and the note on a failed evaluation.
STALE, NOT_EXTRACTED, FAILED = "infinite recursion", "deps not extracted", "dep fill failed (eval timeout or error)"


def filled(records: DataFrame, results: DataFrame, ecosystem: str = "nixpkgs", overwrite: bool = False) -> DataFrame:
    """records(attr, identity, dependencies, provenance, ...) with outcome: filled, skipped or failed.

    results(attr, build, host, runtime) gives the dependencies of evaluated attributes (one row each; of several the
    least counts). Records of other ecosystems, and those with any dependency unless overwrite, are skipped and
    stay as they are; one without an attribute fails and stays; one whose attribute has no result fails and is
    noted. Of a filled record the notes that say its dependencies are unknown go. One left join on the attribute.
    """
    buckets = ("build", "host", "runtime")
    got = results.groupBy("attr").agg(F.min(F.struct(*buckets)).alias("_got"))
    d = F.col("dependencies")
    some = F.lit(False)
    for b in (*buckets, "test"):
        some = some | (F.coalesce(F.size(d[b]), F.lit(0)) > 0)
    skipped = ~F.coalesce(F.col("identity.ecosystem") == ecosystem, F.lit(False)) | (F.lit(not overwrite) & some)
    nameless = F.coalesce("attr", F.lit("")) == ""
    outcome = F.when(skipped, "skipped").when(nameless | F.col("_got").isNull(), "failed").otherwise("filled")
    joined = records.join(got, "attr", "left").withColumn("outcome", outcome)
    new = F.struct(*[F.coalesce(F.col(f"_got.{b}"), F.array().cast(_TEXTS)).alias(b) for b in buckets], d["test"].alias("test"))
    notes = F.coalesce("provenance.warnings", F.array().cast(_TEXTS))
    rest = F.filter(notes, lambda w: ~F.contains(w, F.lit(STALE)))
    tried = (F.col("outcome") == "failed") & ~nameless
    warnings = F.when(F.col("outcome") == "filled", F.filter(rest, lambda w: ~F.contains(w, F.lit(NOT_EXTRACTED)))).when(tried, F.array_append(rest, F.lit(FAILED))).otherwise(notes)
    changed = {"dependencies": F.when(F.col("outcome") == "filled", new).otherwise(d), "provenance": F.col("provenance").withField("warnings", warnings)}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in records.columns], "outcome")


def fill_counts(rows: DataFrame) -> DataFrame:
    """One row: filled, skipped, failed."""
    return rows.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("filled", "skipped", "failed")])

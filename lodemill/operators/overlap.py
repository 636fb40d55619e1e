"""Which names two ecosystems share, which only one has, and where versions disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(records: DataFrame, a: str, b: str, name: str = "name", ecosystem: str = "ecosystem", version: str = "version") -> DataFrame:
    """One row a name: bucket (overlap, only_a, only_b, other), n_versions, version_skew.

    Only_a and only_b ask for that ecosystem and no other; every other mix is "other". Versions of all
    ecosystems count, empty ones do not; skew is more than one version of a shared name. One shuffle, on
    the name, after a partial aggregation.
    """
    eco = F.col(ecosystem)
    per_name = records.groupBy(F.col(name).alias("name")).agg(
        F.coalesce(F.bool_or(eco == a), F.lit(False)).alias("has_a"),
        F.coalesce(F.bool_or(eco == b), F.lit(False)).alias("has_b"),
        F.coalesce(F.bool_or(~eco.isin(a, b)), F.lit(False)).alias("has_other"),
        F.size(F.collect_set(F.nullif(F.col(version), F.lit("")))).cast("long").alias("n_versions"),
    )
    both = F.col("has_a") & F.col("has_b")
    bucket = F.when(both, "overlap").when(F.col("has_a") & ~F.col("has_other"), "only_a").when(F.col("has_b") & ~F.col("has_other"), "only_b").otherwise("other")
    return per_name.select("name", "n_versions", (both & (F.col("n_versions") > 1)).alias("version_skew"), bucket.alias("bucket"))


def summary(classified: DataFrame) -> DataFrame:
    """One row of counts over classify()'s rows."""
    of = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return classified.agg(F.count("*").alias("packages_total"), of("overlap"), of("only_a"), of("only_b"), F.count_if("version_skew").alias("version_skew"), of("other"))

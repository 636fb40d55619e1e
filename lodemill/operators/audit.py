"""Summaries of runs: verification results, audits by status, waves of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.operators import scan


def verify_summary(results: DataFrame, spec: str = "spec") -> DataFrame:
    """spec, total, passed (and not skipped), failed, skipped of results(spec, passed, skipped)."""
    skipped = F.coalesce(F.col("skipped"), F.lit(False))
    passed = F.coalesce(F.col("passed"), F.lit(False))
    return results.groupBy(spec).agg(F.count("*").alias("total"), F.count_if(passed & ~skipped).alias("passed"), F.count_if(~passed & ~skipped).alias("failed"), F.count_if(skipped).alias("skipped"))


#: Fixed value: the error of a specification whose library is not installed.
NO_LIBRARY = "LibraryNotFoundError"


def verify_totals(per_spec: DataFrame) -> DataFrame:
    """One row over verify_summary(): specs that are all right, that have a failure, that were only skipped, and all vectors.

    With a column error, a specification with an error has failed, but one whose library is missing was skipped."""
    error = F.coalesce(F.col("error"), F.lit("")) if "error" in per_spec.columns else F.lit("")
    missing = F.contains(error, F.lit(NO_LIBRARY))
    ok = (F.col("failed") == 0) & (F.col("passed") > 0) & (error == "")
    failed = ((F.col("failed") > 0) | (error != "")) & ~missing
    return per_spec.agg(F.count("*").alias("specs"), F.count_if(ok).alias("specs_ok"), F.count_if(failed).alias("specs_failed"), F.count_if(missing | ((F.col("skipped") == F.col("total")) & ~failed)).alias("specs_skipped"),
                        *[F.sum(c).alias(c) for c in ("total", "passed", "failed", "skipped")])


def status_counts(rows: DataFrame, statuses: list[str], other: str, status: str = "status") -> DataFrame:
    """status, n for each listed status (0 where there is none); any other status counts as `other`."""
    known = F.when(F.col(status).isin(statuses), F.col(status)).otherwise(other)
    counted = rows.groupBy(known.alias("status")).agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(statuses)], "status string, rank int")
    return listed.join(counted, "status", "left").select("status", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def names_by_status(rows: DataFrame, statuses: list[str], other: str, name: str = "name", status: str = "status") -> DataFrame:
    """status, rank, names (sorted, comma-joined) of each listed status that has any; any other status counts as `other`."""
    known = F.when(F.col(status).isin(statuses), F.col(status)).otherwise(other).alias("status")
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("status")) - 1
    return rows.groupBy(known).agg(F.array_join(F.array_sort(F.collect_set(F.col(name).cast("string"))), ",").alias("names")).select("status", rank.alias("rank"), "names")


def audit(rows: DataFrame, success: str, status: str = "status") -> DataFrame:
    """One row: all, successes and their share in ten-thousandths (half up; 0 of none); sums of pass_count, fail_count and
    total_invariants where rows have them."""
    total, good = F.count("*"), F.count_if(F.col(status) == success)
    share = F.when(total > 0, F.floor((good * 20000 + total) / (2 * total))).otherwise(0)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pass_count", "fail_count", "total_invariants") if c in rows.columns]
    return rows.agg(total.alias("total"), good.alias("success"), share.cast("long").alias("rate_e4"), *sums)


def wave_summary(states: DataFrame, statuses: list[str], status: str = "status") -> DataFrame:
    """One row: specs, of each listed status how many, and n_pass, n_fail in all."""
    return states.agg(F.count("*").alias("specs"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.coalesce(F.sum("n_pass"), F.lit(0)).alias("n_pass"), F.coalesce(F.sum("n_fail"), F.lit(0)).alias("n_fail"))


def first_given(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys and the first value by order that is neither null nor empty; null where there is none."""
    given = F.col(value).isNotNull() & (F.col(value) != "")
    return rows.groupBy(*keys).agg(F.min_by(F.when(given, F.col(value)), F.when(given, F.col(order))).alias(value))


def build_summary(log: DataFrame) -> DataFrame:
    """One row over a log of builds(canonical_name, driver, success, error): names, builds that are right, errors, the least name that failed."""
    good = F.coalesce("success", F.lit(False))
    return log.agg(F.count_distinct("canonical_name").alias("specs"), F.count_if(good).alias("ok"), F.count_if(~good).alias("errors"), F.min(F.when(~good, F.col("canonical_name"))).alias("first_failed"))


def allowed(registry: DataFrame, statuses: tuple[str, ...] = ("verified",)) -> DataFrame:
    """The packages of a registry that may be used: those of the given statuses."""
    return registry.where(F.col("status").isin(*statuses))


def with_target(rows: DataFrame, targets: DataFrame, order: str = "ord") -> DataFrame:
    """rows with the first target by order of targets(driver, target, ord) that has the row's driver; null without one."""
    return rows.join(targets.groupBy("driver").agg(F.min_by("target", order).alias("target")), "driver", "left")


#: Definitions of waves by pattern or language alone that may be sent to every task.
MOST_WAVES = 10_000


def in_waves(specs: DataFrame, waves: DataFrame, matches: Column) -> DataFrame:
    """(wave, spec) wherever a wave's condition holds.

    Where waves(names, wave_backend) say names or else a backend, specs(spec, backend) meet them by these, whatever their number;
    only definitions with neither are sent to every task, and no more than MOST_WAVES of them. A name that a wave lists carries
    itself alone as names, for the condition and in the result: the whole list beside each would grow with its square."""
    says = lambda c: F.col(c).isNotNull() if c in waves.columns else F.lit(False)
    rest = waves.where(~says("names") & ~says("wave_backend"))
    n = rest.limit(MOST_WAVES + 1).count()
    if n > MOST_WAVES:
        raise ValueError(f"more than {MOST_WAVES} waves that name neither specifications nor a backend")
    out = specs.join(F.broadcast(rest), matches)
    if "names" in waves.columns:
        every = waves.where(says("names")).select(*[c for c in waves.columns if c != "names"], F.explode(F.array_distinct("names")).alias("_spec"))
        named = every.select(*[F.array("_spec").alias(c) if c == "names" else c for c in waves.columns], "_spec")
        out = out.unionByName(specs.join(named, (F.col("spec") == F.col("_spec")) & matches).drop("_spec"))
    if "wave_backend" in waves.columns:
        out = out.unionByName(specs.join(waves.where(~says("names") & says("wave_backend")), (F.col("backend") == F.col("wave_backend")) & matches))
    return out


def wave_match(names: str = "names", backend: str = "wave_backend", language: str = "wave_lang", exclude: str = "exclude", pattern: str = "pattern") -> Column:
    """Whether a specification (spec, backend, backend_lang) is in a wave that says names, backend, language, exclude (arrays) and pattern, each if given."""
    given = lambda c, then: F.col(c).isNull() | F.coalesce(then, F.lit(False))
    listed = given(names, F.array_contains(names, F.col("spec")))
    return listed & given(backend, F.col(backend) == F.col("backend")) & given(language, F.col(language) == F.col("backend_lang")) & ~F.coalesce(F.array_contains(exclude, F.col("spec")), F.lit(False)) & given(pattern, F.rlike("spec", F.col(pattern)))


def wave_status(matched: DataFrame, state: DataFrame, spec: str = "spec", wave: str = "wave") -> DataFrame:
    """wave, total, done, n_pass, n_fail, status of matched(wave, spec) and state(spec, done, n_pass, n_fail)."""
    near = matched.select(wave, spec).distinct().join(state, spec, "left")
    per = near.groupBy(wave).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("done"), F.lit(False))).alias("done"), F.coalesce(F.sum("n_pass"), F.lit(0)).alias("n_pass"), F.coalesce(F.sum("n_fail"), F.lit(0)).alias("n_fail"))
    return per.withColumn("status", F.when(F.col("done") == 0, "pending").when(F.col("done") < F.col("total"), "partial").otherwise("complete"))


def pending(specs: DataFrame, state: DataFrame, spec: str, retry: tuple[str, ...] = ("failed", "partial", "build_failed")) -> DataFrame:
    """specs that were not tried yet or whose last status asks for another try."""
    near = specs.join(state.select(spec, F.col("status").alias("_status")), spec, "left")
    return near.where(F.col("_status").isNull() | F.col("_status").isin(*retry)).drop("_status")


def numbered_waves(names: DataFrame, name: str = "name") -> DataFrame:
    """wave, names (sorted, comma-joined) by the number after _extra in a name; names without one are left out."""
    number = F.regexp_extract(name, r"_extra([0-9]{3,})", 1)
    return names.where(number != "").groupBy(number.cast("long").alias("wave")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"))


def next_wave(statuses: DataFrame, order: str = "ordinal") -> DataFrame:
    """The first wave by ordinal that is not complete."""
    return statuses.where("status <> 'complete'").orderBy(order).limit(1)


def last_attempt(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """key, n_attempts, status after the last attempt: success (none fails), partial (some pass) or failed."""
    per = attempts.groupBy(key).agg(F.count("*").alias("n_attempts"), F.max_by(F.struct("n_pass", "n_fail"), order).alias("last"))
    status = F.when((F.col("last.n_fail") == 0) & (F.col("last.n_pass") > 0), "success").when(F.col("last.n_pass") > 0, "partial").otherwise("failed")
    return per.select(key, "n_attempts", status.alias("status"))


def numbered_copies(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows with file_name: the name, then name_1, name_2 for further rows of one name in order."""
    at = F.col("_at") - 1
    return scan.scanned(rows, [name], order, at="_at").withColumn("file_name", F.when(at == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), at.cast("string")))).drop("_at")

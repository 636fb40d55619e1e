"""Sequence functions over ordered rows (runs, pairs, batches, running totals), counters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.operators import scan
from lodemill.shared import written


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, run, value, n: consecutive rows of equal value, in order, numbered from 0 within `by`. A key is as many tasks as its rows ask for."""
    table = scan.blocks(rows.select(*dict.fromkeys([*by, *order, value])), by, order)
    before = scan.neighbours(table, by, order, "_last", F.col(value), ahead=False)
    changed = F.col("_last").isNotNull() & ~F.col(value).eqNullSafe(F.col("_last.v"))
    marked = written(before.withColumn("_new", changed.cast("long")), "marked")
    placed = scan.folded(marked, by, order, run=("sum", F.col("_new")))
    return placed.groupBy(*by, "run", value).agg(F.count("*").alias("n"))


def pairs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with next_value, without the last row of each `by`."""
    table = scan.blocks(rows, by, order)
    followed = scan.neighbours(table, by, order, "_next", F.col(value), ahead=True)
    return followed.where("_next IS NOT NULL").select(*rows.columns, F.col("_next.v").alias("next_value"))


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with batch: numbers from 0 that `size` consecutive rows share."""
    return scan.scanned(rows, by, order, at="_at").withColumn("batch", F.floor((F.col("_at") - 1) / size).cast("long")).drop("_at")


def accumulated(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with running_sum, running_max and running_min of the value."""
    return scan.scanned(rows, by, order, **{f"running_{n}": (n, F.col(value)) for n in ("sum", "max", "min")})


def most_common(rows: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, least value first among equals."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(value).asc_nulls_last()).limit(n)


def first_mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, mode: the most frequent value, of equal ones the one met first."""
    per = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def bucket(x: Column, edges: list[float], right: bool = True) -> Column:
    """Where x would be put in sorted edges: after equal ones (right) or before them."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), (lambda e: e <= x) if right else (lambda e: e < x)))


def statistics(value: str) -> list[Column]:
    """Mean, median, sample and population deviation, smallest mode, geometric and harmonic mean (null unless all are above 0)."""
    x = F.col(value).cast("double")
    above = F.min(x) > 0
    return [
        F.avg(x).alias("mean"), F.median(x).alias("median"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stdev"), F.stddev_pop(x).alias("pstdev"), F.mode(F.col(value), True).alias("mode"),
        F.when(above, F.exp(F.avg(F.ln(F.when(x > 0, x))))).alias("geometric_mean"), F.when(above, F.count(x) / F.sum(F.try_divide(F.lit(1.0), x))).alias("harmonic_mean"),
    ]


def spread_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and statistics() of the value, also where one group has most rows: no task holds a group's values.

    Rows are counted a (group, value) first; medians and modes follow from the counts. The values around the middle are
    found by a scan over them in order, which splits a group into blocks."""
    x = F.col(value).cast("double")
    counts = written(rows.groupBy(*by, x.alias("x")).agg(F.count("*").alias("n")), "counts")
    some = counts.where("x IS NOT NULL")
    placed = scan.scanned(some, by, ["x"], totals={"all": ("sum", F.col("n"))}, upto=("sum", F.col("n")))
    # with m values the middle ones are at places (m + 1) div 2 and (m + 2) div 2
    holds = lambda place: (F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)
    middle = placed.select("*", holds(F.floor((F.col("all") + 1) / 2)).alias("_low"), holds(F.floor((F.col("all") + 2) / 2)).alias("_high")).where("_low OR _high")
    median = middle.groupBy(*by).agg(((F.max(F.when(F.col("_low"), F.col("x"))) + F.max(F.when(F.col("_high"), F.col("x")))) / 2).alias("median"))
    mode = some.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("minus"), "x"))["x"].alias("mode"))
    plain = {"mean": F.avg(x), "variance": F.var_samp(x), "stdev": F.stddev_samp(x), "pstdev": F.stddev_pop(x)}
    above = F.min(x) > 0
    plain |= {"geometric_mean": F.when(above, F.exp(F.avg(F.ln(F.when(x > 0, x))))), "harmonic_mean": F.when(above, F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)))}
    out = rows.groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()])
    for part in (median, mode):
        part = part.select(*[F.col(b).alias(f"_{b}") for b in by], part.columns[-1])
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
        out = (out.join(part, same, "left") if by else out.join(F.broadcast(part))).drop(*[f"_{b}" for b in by])
    return out.select(*by, "mean", "median", "variance", "stdev", "pstdev", "mode", "geometric_mean", "harmonic_mean")


def combinations(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, a, b: all pairs a < b of the distinct values within `by` (an equi-join; meant for small groups such as a name's ecosystems)."""
    one = rows.select(*by, value).distinct()
    return one.withColumnRenamed(value, "a").join(one.withColumnRenamed(value, "b"), by).where("a < b")


def permutations(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, a, b: all ordered pairs of different distinct values within `by` (an equi-join; for small groups, as combinations())."""
    one = rows.select(*by, value).distinct()
    return one.withColumnRenamed(value, "a").join(one.withColumnRenamed(value, "b"), by).where("a <> b")


def product(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """All pairs of rows of two tables within `by` (an equi-join; for small groups)."""
    return left.join(right, by)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with at: their place, from 0, in order within `by`."""
    return scan.scanned(rows, by, order, at="at").withColumn("at", F.col("at") - 1)


def sliced(rows: DataFrame, by: list[str], order: list[str], start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """Of each `by` the rows from place `start` up to `stop`, every step-th."""
    at = F.col("at")
    inside = (at >= start) & ((at - start) % step == 0) & (F.lit(True) if stop is None else at < stop)
    return numbered(rows, by, order).where(inside).drop("at")


def zipped(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side by their place in order within `by`; nulls where one is shorter."""
    return numbered(left, by, left_order).join(numbered(right, by, right_order), [*by, "at"], "full_outer")


def smallest(rows: DataFrame, n: int, value: str, order: str) -> DataFrame:
    """The n rows of least value, the earlier one by order first among equals."""
    return rows.orderBy(F.col(value).asc_nulls_last(), F.col(order).asc()).limit(n)


def largest(rows: DataFrame, n: int, value: str, order: str) -> DataFrame:
    """The n rows of greatest value, the later one by order first among equals."""
    return rows.orderBy(F.col(value).desc_nulls_last(), F.col(order).desc()).limit(n)


def merged(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables in one order by the key; of equal keys the earlier table's first."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("_table", F.lit(i))
        every = t if every is None else every.unionByName(t)
    return every.orderBy(key, "_table").drop("_table")


def folded(values: Column, start: Column, step) -> Column:
    """An array reduced from the left: step(so far, element)."""
    return F.aggregate(values, start, step)

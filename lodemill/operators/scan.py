"""Scans over ordered rows in two levels, so that a key with most of the rows is many tasks.

Rows are dealt into blocks by ranges of (key, order): a block is a stretch of the sorted table, whatever the keys'
sizes, and equal rows are told apart by the place they come from. Within a block each key's rows are numbered and
added up by a window; only the first and last key of a block can go on in another one, so what the blocks before
hold of a key is a table of at most two rows a block, and is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.shared import written

#: Of each fold: the aggregate of a stretch of rows, and how the results of two stretches are put together.
FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
}


def _plain(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def blocks(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "blocks") -> DataFrame:
    """rows with _block, a stretch of the table sorted by (by, order), and _tie, which tells equal rows apart; written once."""
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*[F.col(b).asc() for b in by], *map(_plain, order), F.col("_tie").asc())
    return written(dealt.withColumn("_block", F.spark_partition_id()), name)


def held_before(table: DataFrame, by: list[str], **parts: Column) -> DataFrame:
    """Of the keys that a block shares with another one: _of (the block), _by (the key) and the aggregates `parts` of its rows.

    At most two rows a block."""
    key = _key(by)
    ends = table.groupBy("_block").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    edge = ends.select(F.col("_block").alias("_of"), F.explode(F.array_distinct(F.array("first", "last"))).alias("_by"))
    near = table.withColumn("_key", key).join(F.broadcast(edge), (F.col("_block") == F.col("_of")) & (F.col("_key") == F.col("_by")))
    return near.groupBy("_of", "_by").agg(*[c.alias(n) for n, c in parts.items()])


def _key(by: list[str]) -> Column:
    return F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("_all"))


def _beside(table: DataFrame, by: list[str], held: DataFrame) -> DataFrame:
    """table with what `held` (_of, _by, ...; a few rows a block, sent to all tasks) has for a row's block and key."""
    return table.withColumn("_key", _key(by)).join(F.broadcast(held), (F.col("_block") == F.col("_of")) & (F.col("_key") == F.col("_by")), "left")


def scanned(rows: DataFrame, by: list[str], order: list[Column | str], at: str | None = None, totals: dict[str, tuple[str, Column]] | None = None, **folds: tuple[str, Column]) -> DataFrame:
    """rows with `at`, their place from 1 in order within the key, the running folds (name = (kind of FOLDS, column)) and the
    folds of the whole key (totals).

    Nulls are a key of their own and are left out of folds; equal rows have places in an order of their own."""
    asked = {**folds, **(totals or {})}
    inputs = {f"_in_{n}": c for n, (_, c) in asked.items()}
    table = blocks(rows.select("*", *[c.alias(n) for n, c in inputs.items()]), by, order)
    given = lambda some: {n: (kind, F.col(f"_in_{n}")) for n, (kind, _) in some.items()}
    return folded(table, by, order, at, given(totals or {}), **given(folds)).drop("_block", "_tie", *inputs)


def folded(table: DataFrame, by: list[str], order: list[Column | str], at: str | None = None, totals: dict[str, tuple[str, Column]] | None = None, **folds: tuple[str, Column]) -> DataFrame:
    """The table of blocks() with the place, the running folds and the totals."""
    running, whole = dict(folds) | ({at: ("sum", F.lit(1).cast("long"))} if at else {}), totals or {}
    both = running | whole
    stretch = Window.partitionBy("_block", *by).orderBy(*map(_plain, order), F.col("_tie").asc())
    window = lambda n: stretch.rowsBetween(Window.unboundedPreceding, 0 if n in running else Window.unboundedFollowing)
    here = table.withColumns({f"_here_{n}": FOLDS[kind][0](c).over(window(n)) for n, (kind, c) in both.items()})
    per = held_before(table, by, **{n: FOLDS[kind][0](c) for n, (kind, c) in both.items()})
    earlier = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_of", "_by", *[FOLDS[kind][0](n).over(earlier if n in running else Window.partitionBy("_by")).alias(f"_before_{n}") for n, (kind, _) in both.items()])
    joined = _beside(here, by, before)
    out = {n: FOLDS[kind][1](F.col(f"_before_{n}"), F.col(f"_here_{n}")) for n, (kind, _) in running.items()} | {n: F.coalesce(f"_before_{n}", f"_here_{n}") for n in whole}
    return joined.select(*[F.col(f"`{c}`") for c in table.columns], *[c.alias(n) for n, c in out.items()])


def neighbours(table: DataFrame, by: list[str], order: list[str], name: str, value: Column, ahead: bool) -> DataFrame:
    """The table of blocks() with `name`, a struct of the value `v` of the key's next row (ahead) or of the one before it; null where there is none."""
    stretch = Window.partitionBy("_block", *by).orderBy(*map(_plain, order), F.col("_tie").asc())
    held = F.struct(value.alias("v"))
    place = F.struct(*map(_plain, order), F.col("_tie"))
    here = table.withColumn("_here", F.lead(held).over(stretch) if ahead else F.lag(held).over(stretch))
    per = held_before(table, by, end=F.min_by(held, place) if ahead else F.max_by(held, place))
    across = Window.partitionBy("_by").orderBy("_of")
    near = per.select("_of", "_by", (F.lead("end") if ahead else F.lag("end")).over(across).alias("_near"))
    return _beside(here, by, near).select(*[F.col(f"`{c}`") for c in table.columns], F.coalesce("_here", "_near").alias(name))

"""Mixing sources to target weights by capped water-filling.

Targets. Sources share all words by weight; none may be read more than max_epochs times. The level rises in
all sources at once (in units of weight) and a source that reaches its cap stays there while the rest goes on:
with sources in order of cap / weight, the ones before the first that stays below its cap are full, so running
sums over the small table of sources give every target without a loop.

Sampling. target / size is a source's number of repetitions: its whole part is taken of every document; the
fraction is sampled. Documents are dealt by a seeded hash of their id into cells of about cell_rows, and each
cell is gone through from the largest size down: a document is taken once more with the probability that its
fraction, and what the cell is still short or over, ask for. So a cell ends within about one small document of
its share, whatever its large documents did, and a hot source is many cells. Only (source, id, size) rows move.

Main path: DataFrame expressions only.

Rows that agree in source, id and size count as copies of one document and are sampled together (so what has no id is an
item for each source and size, however many rows there are). A null or empty text has
size 0 and nothing is taken of it; a null source is a source, the last one; an empty table gives an empty
table; a source of size 0 has target 0. Results depend on rows and seed only, not on their order or partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.llm.common import WORD, beside, hot_keys, spread_join, text_of, whole
from lodemill.operators.scan import scanned
from lodemill.shared import written

WEIGHTS, MAX_EPOCHS, SEED, CELL_ROWS = (5, 2, 1), 3, 17, 1000
#: Copies of one document that a row may make.
COPIES = 10_000


def n_words(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_rows, target of each source. The weights repeat along the sources by code point, null last.

    One partial aggregation a source; the windows then run over a row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sharing = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("left", left).withColumn("sharing", sharing)
    full = F.col("cap") * F.col("sharing") <= F.col("left") * F.col("weight")
    level = F.max(F.when(~full, F.col("left").cast("double") / F.col("sharing"))).over(everything)
    return levelled.select("source", "source_size", "n_rows", F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _hash_part(at: int) -> Column:
    """32 bits of a hash of seed and id."""
    return F.conv(F.substring("hash", at, 8), 16, 10).cast("long")


def sample(sizes: DataFrame, wanted: DataFrame, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, whole, extra: each row's document is taken `whole` times,
    and `extra` of its `copies` rows once more."""
    items = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    near = items.join(wanted, items["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = near.withColumn("times", times).withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    cells = keyed.withColumn("cell", _hash_part(9) % F.ceil(F.col("n_rows") / cell_rows)).groupBy("source", "cell")
    held = cells.agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("times").alias("times"),
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "hash", "doc_id", "size", "copies"))).alias("items"),
    )
    fraction = F.col("times") - F.floor("times")

    def step(acc: Column, x: Column) -> Column:
        size, copies = x["size"], x["copies"]
        u = F.conv(F.substring(x["hash"], 1, 8), 16, 10).cast("long").cast("double") / 4294967296.0
        due = fraction * (size * copies).cast("double") + acc["carry"]
        extra = F.when(size > 0, F.greatest(F.lit(0).cast("long"), F.least(copies, F.floor(due / size.cast("double") + u)))).otherwise(F.lit(0).cast("long"))
        return F.struct((due - (extra * size).cast("double")).alias("carry"), F.concat(acc["extra"], F.array(extra)).alias("extra"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("extra"))
    chosen = held.withColumn("extra", F.aggregate("items", start, step, lambda acc: acc["extra"]))
    rows = chosen.select("source", "source_size", "target", F.floor("times").alias("whole"), F.explode(F.arrays_zip("items", "extra")).alias("x"))
    return rows.select(F.col("x.items.doc_id").alias("doc_id"), "source", F.col("x.items.size").alias("size"), "source_size", "target", F.col("x.items.copies").alias("copies"), "whole", F.col("x.extra").alias("extra"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, written once: texts are read and counted one time."""
    return written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size")), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, repeats."""
    sizes = measured(docs)
    chosen = sample(sizes, targets(sizes, weights, max_epochs), seed)
    return one_a_copy(written(chosen, "chosen")).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("copy") <= F.col("extra")).cast("long")).alias("repeats"))


def one_a_copy(chosen: DataFrame, most: int = COPIES) -> DataFrame:
    """chosen with a row for each of its `copies`, numbered by `copy` from 1.

    More than `most` copies are first cut into stretches of so many, which are dealt out, so that no row or task makes them all."""
    ranged = lambda low, high: F.explode(F.sequence(low, high)).alias("copy")
    few = chosen.where(F.col("copies") <= most).select("*", ranged(F.lit(1).cast("long"), F.col("copies")))
    cut = chosen.where(F.col("copies") > most).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most))).alias("stretch"))
    low = F.col("stretch") * most
    many = cut.repartition("doc_id", "source", "size", "stretch").select("*", ranged(low + 1, F.least(low + most, F.col("copies")))).drop("stretch")
    return few.unionByName(many)


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it (none: the row goes); columns as in docs, whatever their names.

    Of rows that count as copies the first ones by their text's hash are taken once more. Keys with many copies are salted where
    rows meet what is taken of them, and copies are numbered in blocks of their order, so that no task holds all of a key."""
    sizes = measured(docs)
    key = lambda: F.struct(F.col("doc_id"), F.col("source"), F.col("size")).alias("key")
    chosen = written(sample(sizes, targets(sizes, weights, max_epochs), seed).where(F.col("size") > 0).select(key(), "copies", "whole", "extra"), "chosen")
    many = chosen.where("copies > 1")
    hot = hot_keys(many.select("key", F.col("copies").alias("n")), "key", chosen.agg(F.sum("copies")).first()[0] or 0)
    sized = beside(docs, doc_id=F.col("doc_id"), source=F.col("source").cast("string"), size=n_words("text")).select("row", key())
    # what has copies goes a way of its own, so that texts are dealt out once where nothing has
    cold = sized.join(F.broadcast(hot.select("key")), "key", "left_anti")
    numbered = cold.join(chosen.where("copies = 1").hint("merge"), "key").select("row", "whole", "extra", F.lit(1).cast("long").alias("copy"))
    if not many.isEmpty():
        several = spread_join(sized, many, "key", hot, "inner").select("row", "key", "whole", "extra", F.xxhash64(text_of(F.col("row.text"))).alias("text_hash"))
        numbered = numbered.unionByName(scanned(several, ["key"], ["text_hash"], at="copy").select("row", "whole", "extra", "copy"))
    times = (F.col("whole") + (F.col("copy") <= F.col("extra")).cast("long")).cast("int")
    taken = numbered.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return whole(taken.select("row"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP10_SQL = rf"""
WITH RECURSIVE sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sizes GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, source_size * 3 AS cap FROM per),
levelled AS (SELECT *, (SELECT sum(source_size) FROM per)::BIGINT - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS sharing FROM ranked WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
wanted AS (SELECT source, source_size, n_rows, CASE WHEN cap * sharing <= rest * weight THEN cap::DOUBLE
    ELSE max(CASE WHEN cap * sharing > rest * weight THEN rest::DOUBLE / sharing END) OVER () * weight END AS target FROM levelled),
items AS (SELECT source, doc_id, size, count(*) AS copies FROM sizes GROUP BY ALL),
keyed AS (SELECT i.*, w.source_size, w.target, CASE WHEN w.source_size > 0 THEN w.target / w.source_size ELSE 0.0 END AS times, w.n_rows,
    md5('{SEED}:' || coalesce(i.doc_id::VARCHAR, '')) AS h FROM items i JOIN wanted w ON i.source IS NOT DISTINCT FROM w.source),
celled AS (SELECT *, ('0x' || substr(h, 9, 8))::BIGINT % ceil(n_rows / {CELL_ROWS}.0)::BIGINT AS cell, ('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM keyed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY size DESC, h, doc_id NULLS FIRST) AS rn FROM celled),
walk AS (
    SELECT o.source, o.cell, o.rn, 0.0::DOUBLE AS carry, 0::BIGINT AS extra FROM (SELECT DISTINCT source, cell, 0::BIGINT AS rn FROM ordered) o
    UNION ALL
    SELECT source, cell, rn, due - (extra * size)::DOUBLE, extra FROM (
        SELECT *, CASE WHEN size > 0 THEN greatest(0::BIGINT, least(copies, floor(due / size::DOUBLE + u)::BIGINT)) ELSE 0::BIGINT END AS extra FROM (
            SELECT o.*, (o.times - floor(o.times)) * (o.size * o.copies)::DOUBLE + w.carry AS due
            FROM walk w JOIN ordered o ON w.source IS NOT DISTINCT FROM o.source AND w.cell = o.cell AND o.rn = w.rn + 1))
)
SELECT o.doc_id, o.size, o.source_size, o.target, o.size * (floor(o.times)::BIGINT + (CASE WHEN g.copy <= w.extra THEN 1 ELSE 0 END)) AS taken
FROM ordered o JOIN walk w ON w.source IS NOT DISTINCT FROM o.source AND w.cell = o.cell AND w.rn = o.rn, unnest(range(1, o.copies + 1)) AS g(copy)
"""

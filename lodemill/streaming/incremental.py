"""Incremental work as streams of files: rerun on new or rewritten files, append logs, keyed state, differences of runs from a baseline."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodemill import shared
from lodemill.operators import compare


def watched(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls each(rows, batch) on the rows of JSON files that are new in a folder; once: what is there now, then the end."""
    stream = spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 second")).start()


def appended(rows: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream's rows to a log of JSON lines, each once."""
    stream = rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (stream.trigger(availableNow=True) if once else stream).start()


def upserted(state: DataFrame | None, rows: DataFrame, key: str, order: str) -> DataFrame:
    """State with each key's newest row; repeating a batch changes nothing."""
    every = rows if state is None else state.unionByName(rows)
    others = [c for c in every.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others)))
    return every.groupBy(key).agg(newest.alias("_new")).select(key, *[F.col(f"_new.{c}").alias(c) for c in others])


#: So many stretches of batches are put together into one.
FANOUT = 8


def _stretches(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """(first, last) batch of the complete tables in a state's folder."""
    return sorted(tuple(map(int, n.split("-"))) for n in shared.names(spark, folder) if re.fullmatch(r"\d+-\d+", n) and shared.exists(spark, f"{folder}/{n}/_SUCCESS"))


def _covering(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The fewest tables that hold all batches: from each batch on the longest stretch."""
    out, at = [], 0
    while longest := max((s for s in stretches if s[0] == at), default=None):
        out.append(longest)
        at = longest[1] + 1
    return out


def state(spark: SparkSession, folder: str, key: str, order: str) -> DataFrame:
    """Each key's newest row of what keeping_state() has kept so far."""
    held = _covering(_stretches(spark, folder))
    if not held:
        raise FileNotFoundError(f"no state in {folder}")
    return upserted(None, spark.read.parquet(*[f"{folder}/{a}-{b}" for a, b in held]), key, order)


def keeping_state(spark: SparkSession, folder: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps each key's newest row, readable by state().

    A batch writes a table of its own keys. Whenever FANOUT tables of one size are there they are put together into one,
    so a row is written about log(batches) / log(FANOUT) times in all, whatever the state has grown to. Tables that a larger
    one holds go one batch later, so that who reads them can end. A repeated batch writes the same tables again."""

    def each(rows: DataFrame, batch: int) -> None:
        done = _stretches(spark, folder) if batch else []
        upserted(None, rows, key, order).write.mode("overwrite").parquet(f"{folder}/{batch}-{batch}")
        size = FANOUT
        while (batch + 1) % size == 0:
            first, step = batch + 1 - size, size // FANOUT
            parts = [f"{folder}/{a}-{a + step - 1}" for a in range(first, batch + 1, step)]
            upserted(None, spark.read.schema(rows.schema).parquet(*parts), key, order).write.mode("overwrite").parquet(f"{folder}/{first}-{batch}")
            size *= FANOUT
        for a, b in done:
            if any((c, d) != (a, b) and c <= a and b <= d for c, d in done):
                shared.drop(spark, f"{folder}/{a}-{b}")

    return each


def against_baseline(baseline: DataFrame, keys: list[str], folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: results(run, keys, passed, n_results) of runs, each against a baseline once it is complete.

    A run is complete when as many of its results have come as n_results says (any row of it may; null: not said there), in
    however many batches and whatever their order; a result that comes again counts once. Changes (run, keys, change) are the
    table of the batch that completed the run, in folder/diff. A batch's results are written once, in folder/results, and go
    when no open run reaches back to them; folder/open has a row an open run. A repeated batch writes the same again."""

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = lambda what, n: f"{folder}/{what}/batch={n}"
        rows.select("run", *keys, "passed", "n_results").write.mode("overwrite").parquet(at("results", batch))
        own = spark.read.schema(rows.select("run", *keys, "passed", "n_results").schema).parquet(at("results", batch))
        per = own.groupBy("run").agg(F.count_distinct(F.struct(*keys)).alias("n"), F.max("n_results").alias("wanted")).withColumn("first", F.lit(batch).cast("long"))
        if batch:
            per = per.unionByName(spark.read.schema(per.schema).parquet(at("open", batch - 1)))
        runs = shared.written(per.groupBy("run").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted"), F.min("first").alias("first")), "runs")
        near = runs.where("n >= wanted")  # those that may be complete: repeated results count there
        schema = own.schema.add("batch", "long")
        held = spark.read.schema(schema).parquet(f"{folder}/results").where(F.col("batch") <= batch)
        since = near.agg(F.min("first")).first()[0]
        results = held.where(F.col("batch") >= since) if since is not None else held.limit(0)
        mine = results.join(F.broadcast(near.select("run", "first", "wanted")), "run").where("batch >= first").groupBy("run", "wanted", *keys).agg(F.max_by("passed", "batch").alias("passed"))
        mine = shared.written(mine, "complete")
        full = shared.written(mine.groupBy("run", "wanted").agg(F.count("*").alias("n")).where("n >= wanted").select("run"), "full")
        complete = [r.run for r in full.collect()]  # runs that end within one batch are few
        current = mine.join(F.broadcast(full), "run", "left_semi").select("run", *keys, "passed")
        expected = baseline.withColumn("run", F.explode(F.array(*map(F.lit, complete)))) if complete else baseline.withColumn("run", F.lit(None).cast(current.schema["run"].dataType)).limit(0)
        compare.baseline_diff(expected, current, ["run", *keys]).write.mode("overwrite").parquet(at("diff", batch))
        left = runs.join(F.broadcast(full), "run", "left_anti")
        left.write.mode("overwrite").parquet(at("open", batch))
        oldest = spark.read.parquet(at("open", batch)).agg(F.min("first")).first()[0]
        for what, keep in (("results", min(batch - 1, batch if oldest is None else oldest)), ("open", batch - 1)):
            for name in shared.names(spark, f"{folder}/{what}"):
                if name.startswith("batch=") and int(name[6:]) < keep:
                    shared.drop(spark, f"{folder}/{what}/{name}")

    def each(rows: DataFrame, batch: int) -> None:
        with shared.scratch(rows.sparkSession):
            step(rows, batch)

    return each


LISTING = "path string, modified timestamp, length long, digest string"


def changed_files(spark: SparkSession, folder: str, seen: DataFrame, pattern: str = "*") -> DataFrame:
    """LISTING and `change` (same, changed) of the files below a folder against an earlier listing.

    Files of the same path, time and length are taken as the same; only of others the contents are read, and a file whose
    digest is as before is the same after all. Files that are gone are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    names = files.select("path", F.col("modificationTime").alias("modified"), "length")
    before = seen.select("path", F.col("modified").alias("was"), F.col("length").alias("had"), "digest")
    listed = names.join(before, "path", "left")
    untouched = (F.col("modified") == F.col("was")) & (F.col("length") == F.col("had"))
    same = listed.where(untouched).select("path", "modified", "length", "digest", F.lit("same").alias("change"))
    open_ = listed.where(~F.coalesce(untouched, F.lit(False))).select("path", F.col("digest").alias("old"))
    read = files.join(open_, "path").select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("digest"), "old")
    return same.unionByName(read.select("path", "modified", "length", "digest", F.when(F.col("digest") == F.col("old"), "same").otherwise("changed").alias("change")))


def rerun(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], kept: str, pattern: str = "*.json") -> int:
    """One look at a folder: each(rows, n) on the rows of JSON files that are new or were rewritten, if there are any; returns their number.

    Listings are the tables kept/0, kept/1, ...; the last two stay. Only when each() is through is the new one written, so after
    a failure the same files come again under the same n. rows have _path, the file that a row is from."""
    versions = sorted(int(n) for n in shared.names(spark, kept) if n.isdigit() and shared.exists(spark, f"{kept}/{n}/_SUCCESS"))
    n = versions[-1] + 1 if versions else 0
    seen = spark.read.schema(LISTING).parquet(f"{kept}/{n - 1}") if n else spark.createDataFrame([], LISTING)
    with shared.scratch(spark):
        listing = shared.written(changed_files(spark, folder, seen, pattern), "listing")
        paths = [r.path for r in listing.where("change = 'changed'").select("path").toLocalIterator()]  # names only, as Spark's own reader lists them
        if paths:
            each(spark.read.schema(schema).json(paths).withColumn("_path", F.col("_metadata.file_path")), n)
        if paths or not n or listing.count() != seen.count():
            listing.drop("change").write.mode("overwrite").parquet(f"{kept}/{n}")
            for old in versions[:-1]:
                shared.drop(spark, f"{kept}/{old}")
    return len(paths)


def watched_changes(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], kept: str, checkpoint: str, seconds: int = 1) -> StreamingQuery:
    """rerun() again and again, as a stream that runs until it is stopped: what a file source does for new files, also for rewritten ones."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: rerun(spark, folder, schema, each, kept)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

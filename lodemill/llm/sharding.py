"""Dealing documents into shards of equal bytes by Karmarkar-Karp differencing.

Rows of one text are a group, which no shard may split. A partial partition is one sum of bytes a shard; the two of
the largest spread (greatest less least sum) are combined again and again, the fullest shard of one with the
emptiest of the other, until a single one is left. Read backwards, the combinations say which shard each group is in.

At scale. Bytes are added up a group in one shuffle of (hash, size), combined before it; a group of more than one
in ITEMS of all bytes is an item of its own, so there are fewer than ITEMS of them; the others are put by their hash
into ITEMS bundles. The differencing sees at most 2 * ITEMS items at every size of the table, in one task. Its
result, a row an item, is sent to all tasks, so no text is shuffled to learn its shard. Slots are numbered in blocks
of (shard, doc_id), so a shard is many tasks.

Groups are told apart by 64 bits of a hash and the size: two texts that clash would share a shard, nothing else.
A null text counts as the empty one, of size 1; rows without an id are placed as all others and numbered first;
equal rows have slots of their own; an empty table gives an empty table. The result depends on the rows alone, not
on their order or partition (equal rows may swap their slots).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import beside, text_of, unused
from lodemill.operators.scan import scanned
from lodemill.shared import written

SHARDS, ITEMS = 8, 20_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by repeatedly combining the two partial partitions of largest spread."""
    if not sizes:
        return []
    # a partial partition: its sums in descending order less the least of them; who made it: an item or two others
    made: list[tuple] = [(i,) for i in range(len(sizes))]
    sums: list[list[int]] = [[s] + [0] * (shards - 1) for s in sizes]
    # item i's shard within its own partial partition is 0; places[k] are the two orders in which k's parts were joined
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        order = sorted(range(shards), key=joined.__getitem__, reverse=True)
        place = [0] * shards
        for new, old in enumerate(order):
            place[old] = new
        least = joined[order[-1]]
        made.append((a, b, place))
        sums.append([joined[old] - least for old in order])
        sums[a] = sums[b] = []
        heapq.heappush(heap, (-sums[-1][0], len(made) - 1))
    out = [0] * len(sizes)
    todo = [(len(made) - 1, list(range(shards)))]  # a partial partition and the final shard of each of its places
    while todo:
        k, final = todo.pop()
        if len(made[k]) == 1:
            out[k] = final[0]
            continue
        a, b, place = made[k]
        todo.append((a, [final[place[j]] for j in range(shards)]))
        todo.append((b, [final[place[shards - 1 - j]] for j in range(shards)]))
    return out


def size_of(text: str | Column) -> Column:
    """Bytes in UTF-8 and one."""
    return (F.octet_length(text_of(text)) + 1).cast("long")


def group_of(text: str | Column) -> Column:
    return F.xxhash64(text_of(text))


def placed(groups: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """item, own, shard of groups(item, size): groups of more than one in `items` of all bytes by themselves (own), the
    others in bundles by pmod(item, items). Fewer than 2 * items rows."""
    marked = groups.withColumn("own", F.col("size") * items > groups.agg(F.sum("size")).scalar())
    put = F.when(F.col("own"), F.col("item")).otherwise(F.pmod("item", F.lit(items)))
    few = marked.groupBy("own", put.alias("item")).agg(F.sum("size").alias("size"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((-size, own, item) for b in batches for own, item, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        found = difference([-r[0] for r in rows], shards)
        yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(found, pa.int32())], names=["item", "own", "shard"])

    return few.select("own", "item", "size").repartition(1).mapInArrow(solved, "item long, own boolean, shard int")


def shard_of(rows: DataFrame, group: str, size: str, shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """rows with `shard`, those of one group in the same one; the sums of size are near equal. `rows` is read twice."""
    per = written(rows.groupBy(F.col(group).alias("item")).agg(F.sum(size).alias("size")), "groups")
    found = written(placed(per, shards, items), "shards")  # fewer than 2 * items rows of 13 bytes: sent to all tasks
    own = F.broadcast(found.where("own").select(F.col("item").alias(group), F.col("shard").alias("_own")))
    rest = F.broadcast(found.where("NOT own").select(F.col("item").alias("_bundle"), F.col("shard").alias("_rest")))
    joined = rows.withColumn("_bundle", F.pmod(group, F.lit(items))).join(own, group, "left").join(rest, "_bundle", "left")
    return joined.withColumn("shard", F.coalesce("_own", "_rest")).drop("_own", "_rest", "_bundle")


def assigned(docs: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; each text is read once."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), size_of("text").alias("size"), F.crc32(text_of("text")).alias("text_crc32"), group_of("text").alias("group")]
    narrow = written(docs.select(*columns), "sizes")
    dealt = shard_of(narrow, "group", "size", shards, items)
    numbered = scanned(dealt, ["shard"], ["doc_id", "group"], at="place")
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - 1).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, items: int = ITEMS) -> None:
    """docs as Parquet in a folder a shard (shard=0, ...; more _ before the name where docs has such a column)."""
    rows = shard_of(beside(docs, group=group_of("text"), size=size_of("text")), "group", "size", shards, items)
    name = unused(docs, "shard")[0]
    rows.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def op13_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is `bytes`: equal texts stay together and shards are near equal in bytes."""
    rows = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

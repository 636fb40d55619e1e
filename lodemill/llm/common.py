"""What the operators of this subpackage share: the word pattern, whole rows beside columns, hot keys, training sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.shared import written

#: A word is a run without ASCII white space, in Python's, Java's and RE2's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate(): A-Z in lower case.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, joined as bytes: that is quicker than looking them up or making numbers of them."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df if it has at most `rows` rows, else the first ones by a hash of the keys (ties: by all columns), about and at most `rows`."""
    n = df.count()
    if n <= rows:
        return df
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    return df.where(h < int((1 << 30) * min(1.0, 2 * rows / n))).orderBy(h, *[F.col(c) for c in df.columns]).limit(rows)


def training_set(docs: DataFrame, rated: DataFrame, describe: Callable[[str], tuple[int, bytes]], most: int) -> list[tuple[int, bytes]]:
    """(label, payload) of the documents of rated(doc_id, label), a bounded table: describe(text) gives (size, payload).

    Each id counts once (of several texts or labels the least by the payload's hash). Documents are taken in the
    order of a hash of their id while their sizes add up to at most `most`, which bounds the driver's memory; those
    that are larger by themselves are left out. The order of the list depends on its contents alone.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                size, payload = describe(batch.column(2)[at].as_py())
                rest = [pa.array([size], type=pa.int64()), pa.array([payload], type=pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), *rest], names=["doc_id", "label", "size", "payload"])

    picked = F.broadcast(rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(picked, "doc_id").select("doc_id", "label", "text")
    made = rows.mapInArrow(described, "doc_id long, label int, size long, payload binary").where(F.col("size").between(1, most))
    one = made.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("payload").alias("h"), "label", "size", "payload")).alias("x"))
    table = written(one.select("doc_id", "x.label", "x.size", "x.payload"), "training")
    inside = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = table.select("doc_id", inside.alias("total")).where(F.col("total") <= most).select("doc_id")
    return sorted((r.label, bytes(r.payload)) for r in table.join(F.broadcast(within), "doc_id").select("label", "payload").collect())


def columns_of(docs: DataFrame) -> list[Column]:
    """docs' columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with as many _ before it as make it none of docs' columns."""
    held = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def beside(docs: DataFrame, **more: Column) -> DataFrame:
    """docs' rows whole in one column `row`, and further columns beside it that no column of docs can clash with; whole() undoes it."""
    return docs.select(F.struct(*columns_of(docs)).alias("row"), *[c.alias(n) for n, c in more.items()])


def whole(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


#: A key with more than one in HOT of all rows is hot, so there are fewer than HOT of them; each is dealt to SALTS tasks.
HOT, SALTS = 1000, 32


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """The hot keys of counts(key, n) over `total` rows: fewer than HOT rows, so they may be broadcast."""
    return counts.where(F.col("n") * HOT > total).select(key, F.lit(True).alias("hot"))


def spread_join(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """rows joined to few (one row a key) on the key; rows of hot keys are dealt to SALTS tasks by the partition they are in.

    The join is by sorting at every size: few grows with the data, so its plan should not turn on how much there is."""
    hot = F.broadcast(hot)
    salted = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)).drop("hot")
    copies = few.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))).drop("hot")
    return salted.join(copies.hint("merge"), [key, "salt"], how).drop("salt")


def text_of(column: str | Column) -> Column:
    """A text column as a string, null as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))

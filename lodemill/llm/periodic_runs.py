"""Periodic runs of words, found on a harmonic grid with prefix hashes.

A run of period q and length 2q or more holds a stretch of q or more places i whose words i and i + q agree, and so
a place that is a multiple of q. For every period q the grid has the pairs (i, i + q), i a multiple of q: n / q of
them, and so n log n in all. Pairs whose own words differ extend nowhere; for all others at once a binary search over
prefix hashes finds how far the words agree to the right and to the left (their longest common extensions). What
agrees over q places or more is a stretch of period q that no neighbouring word extends. Words are then compared
themselves; should hashes have said too much, the stretch is measured again word by word. One stretch found with
several periods, or from several grid points, is one run, of the least period.

Whole texts are searched, document by document in one pass without a shuffle. Memory is that of a document's words
and of GRID pairs: the grid is gone through in parts, and what a part finds is merged before the next one.

A null or empty text, or one of white space, has no words and no runs. Runs come by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import mix, text_of

#: A run's least length in words.
LEAST = 12
#: Pairs searched at once.
GRID = 1 << 19

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), 0x9E3779B97F4A7C15, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0 that are equal where the words are."""
    found: dict[bytes, int] = {}
    return np.fromiter((found.setdefault(w, len(found)) for w in words), dtype=np.int64, count=len(words))


def grid(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid's pairs whose words agree, at most about GRID pairs at a time.

    The k-th grid points of all periods are two slices of the words, of steps k and k + 1; from the root of n on it is
    fewer slices to take all grid points of a period instead."""
    n = len(ids)
    most = n // 2
    root = int(most**0.5)
    for k in range(root + 1):  # places k*q of periods q > root
        last = min(most, (n - 1) // (k + 1))
        for low in range(root + 1, last + 1, GRID):
            high = min(last + 1, low + GRID)
            here = ids[k * low : k * (high - 1) + 1 : k] if k else np.full(high - low, ids[0])
            same = np.flatnonzero(here == ids[(k + 1) * low : (k + 1) * (high - 1) + 1 : k + 1])
            if len(same):
                yield (same + low) * k, same + low
    for q in range(1, root + 1):  # and places from (root + 1)*q on of those, all places of the others
        for low in range(0, n - q, q * GRID):
            high = min(n - q, low + q * GRID)
            same = np.flatnonzero(ids[low:high:q] == ids[low + q : high + q : q])
            if len(same):
                yield same * q + low, np.full(len(same), q)
    for q in range(root + 1, most + 1):
        first = (root + 1) * q
        if first + q < n:
            same = np.flatnonzero(ids[first : n - q : q] == ids[first + q :: q])
            if len(same):
                yield same * q + first, np.full(len(same), q)


def longest(prefix: np.ndarray, at: np.ndarray, period: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` to the right (step 1; or before `at`, to the left: -1) agree with those a period further, at most `most`."""
    power = powers(len(prefix))
    shift = power[period]
    low, high = np.zeros(len(at), dtype=np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        i, q = at[open_], period[open_]
        middle = (low[open_] + high[open_] + 1) >> 1
        begin, end = (i, i + middle) if step > 0 else (i - middle, i)
        agree = (prefix[end] - prefix[begin]) * shift[open_] == prefix[end + q] - prefix[begin + q]
        low[open_] = np.where(agree, middle, low[open_])
        high[open_] = np.where(agree, high[open_], middle - 1)


def measured(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch around a grid point whose words agree with those a period further, word by word."""
    differ = np.flatnonzero(ids[:-period] != ids[period:])
    k = int(np.searchsorted(differ, at))
    return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) if k < len(differ) else len(ids) - period)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    values = mix(ids.astype(np.uint64) + np.uint64(1))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(n)[:n], out=prefix[1:])
    found: dict[tuple[int, int], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def search() -> None:
        at, period = np.concatenate([a for a, _ in held]), np.concatenate([q for _, q in held])
        held.clear()
        right = longest(prefix, at, period, n - period - at, 1)
        left = longest(prefix, at, period, at, -1)
        enough = np.flatnonzero(left + right >= np.maximum(period, LEAST - period))
        at, period, start, stop = at[enough], period[enough], (at - left)[enough], (at + right)[enough]
        if not len(at):
            return
        order = np.lexsort((stop, start, period))
        at, period, start, stop = at[order], period[order], start[order], stop[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(period) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0)
        firsts = np.flatnonzero(first)
        for j, end in zip(firsts, [*firsts[1:], len(at)], strict=True):
            s, e, q = int(start[j]), int(stop[j]), int(period[j])
            if np.array_equal(ids[s:e], ids[s + q : e + q]):
                stretches = {(s, e)}
            else:  # hashes said too much: each grid point's own stretch
                stretches = {measured(ids, int(i), q) for i in at[j:end]}
            for s, e in stretches:
                if e - s >= max(q, LEAST - q):
                    found[s, e + q] = min(q, found.get((s, e + q), q))

    for pair in grid(ids):
        held.append(pair)
        count += len(pair[0])
        if count >= GRID:
            search()
            count = 0
    if held:
        search()
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run is cut to its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def periodic(text: str | Column) -> Column:
    """struct<n_words, runs, collapsed> of a text: its runs, and its words without what repeats a run's first period, joined by a space."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(column: pa.Array) -> pa.Array:
        n_words, runs, collapsed = [], [], []
        for x in column:
            words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            own = runs_of(numbers(words))
            kept = kept_words(len(words), own) if own else None
            n_words.append(len(words))
            runs.append([{"start": s, "length": e, "period": q} for s, e, q in own])
            collapsed.append(b" ".join(words if kept is None else [words[i] for i in np.flatnonzero(kept)]))
        text = pa.array(collapsed, pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run)), text], names=["n_words", "runs", "collapsed"])

    return F.arrow_udf(found, FOUND)(text_of(text))


def planted(doc_id: Column, text: Column) -> Column:
    """The text; with h = crc32(decimal id) and g = h div 10, where h ends in 0 its words instead, joined by a space, every word i >= a
    being word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Without an id nothing is changed."""

    def changed(crcs: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for h, x in zip(crcs.to_pylist(), texts, strict=True):
            if h is None or h % 10:
                out.append(x.as_py())
                continue
            words, g = x.as_py().encode("utf-8", "surrogatepass").split(), h // 10
            n = len(words)
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
            out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.array(out, pa.string())

    return F.arrow_udf(changed, "string")(F.crc32(doc_id.cast("string")), text_of(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs.select("doc_id", periodic(planted(F.col("doc_id"), F.col("text"))).alias("x")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id and x = periodic(text) as numbers of the longest run and digests of all."""
    runs = F.col("x.runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    with_best = found.withColumn("best", best)
    return with_best.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.minus")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.minus") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2(F.col("x.collapsed"), 256).alias("collapsed_sha256"),
    )

"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (a run of .?! before white space ends one, and so does a line's end; sentences
of more than LONG words are cut after words that are the least by hash of some CUT words in a row, so passages
without full stops have spans too, and what stands before a passage moves none of its cuts: two copies of CUT
words have a cut in common). From each
sentence the shortest run of at least RUN sentences and WORDS words is a span, and so is the shortest that ends
at each sentence: whatever longer run is repeated, each of its sentences is in one of them. A span's 128-bit hash
covers its words, ASCII-lower-cased, so passages agree wherever their lines break. All spans are grouped by hash: a
span at two places is repeated, the place of least (doc_id, position) stays, and the sentences under every
other place are removed.

Only hashes and places move in the global step, with a minimum and a maximum a hash as a partial
aggregation, so a passage in very many documents is a row a task; the join back to places has only repeated
hashes on its small side, a written table, so that its skewed partitions can be split. Then one shuffle
brings each document its number of sentences and the positions to remove. Only documents with removals, and those too short
for a span, are parsed again; the other texts do not go through Python a second time.

Defined cases: null and empty texts have no sentence and stay as they are; rows equal in doc_id and text are
one place and get the same result; rows without an id come last in the order; an empty table gives an empty
table; texts are read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import FOLD, mix, text_of, word_hashes
from lodemill.shared import written

RUN, WORDS = 2, 25
LONG, CUT = 25, 12

#: For bytes.translate(): 1 for a stop, 2 for white space, 3 for a line's end, 0 for all else.
_KIND = bytes({**dict.fromkeys(b".?!", 1), **dict.fromkeys(b" \t\v\f\r", 2), 10: 3}.get(b, 0) for b in range(256))
#: White space of str.split() that does not part words here: what looks empty by it is no sentence, and it counts for LONG.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RNG = np.random.default_rng(11)
_BASES = [int(x) for x in _RNG.integers(1, 2**62, 2) * 2 + 1]
_BACK = [pow(b, -1, 2**64) for b in _BASES]


def _cuts(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sentences of n words with these hashes, one after the other: the numbers of words after which they are cut, without their ends."""
    if len(hashes) < CUT:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64(0xFFFFFFFF)
    # the least of a window's hashes, the last one of equals, with its place in the low half
    least = (hashes | low) - np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < CUT:
        step = min(width, CUT - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    of = np.repeat(np.arange(len(n)), n)
    place = np.unique(low - (least & low)[of[: len(least)] == of[CUT - 1 :]]).astype(np.int64)
    return place[place + 1 < np.cumsum(n)[of[place]]] + 1


def _parsed(text: str, whole: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A text in UTF-8, the ends of its sentences in bytes and in words, and, if whole, the hashes of its words (else none).

    A sentence without words goes with the one before. Words are found once, by numpy; only those of long sentences need hashes."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return data, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    kind = np.frombuffer((b" " + data).translate(_KIND), dtype=np.uint8)
    space = kind > 1
    at = np.flatnonzero(space[:-1] > space[1:])
    # a sentence ends where the first word after a line's end, or after a stop before white space, begins, and with the text
    stop = kind[1:] == 3
    stop[:-1] |= (kind[1:-1] == 1) & space[2:]
    begins = np.zeros(len(at) + 1, dtype=bool)
    begins[np.searchsorted(at, np.flatnonzero(stop), side="right")] = True
    begins[-1] = True
    upto = np.flatnonzero(begins)
    ends = np.concatenate((at, [len(data)]))[upto]
    if _WIDE.search(text):
        n = np.array([len(p.decode("utf-8", "surrogatepass").split()) for p in _pieces(data, ends)], dtype=np.int64)
        held = np.flatnonzero(np.concatenate((n[1:] > 0, np.ones(1, dtype=bool))))
        ends, upto, n = ends[held], upto[held], n[np.concatenate(([0], held[:-1] + 1))]
    else:
        n = upto - np.concatenate(([0], upto[:-1]))
    long = n > LONG
    if not whole and not long.any():
        return data, ends, upto, np.zeros(0, dtype=np.uint64)
    words = data.translate(FOLD).split()
    hashes = word_hashes(words) if whole else np.zeros(0, dtype=np.uint64)
    if long.any():
        begins = np.concatenate(([0], upto[:-1]))[long]
        n = upto[long] - begins
        place = np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        inside = hashes[place] if whole else word_hashes([w for a, b in zip(begins.tolist(), upto[long].tolist(), strict=True) for w in words[a:b]])
        cut = place[_cuts(inside, n)]
        # a first or last sentence may be without words, so ends are told apart by bytes
        ends = np.concatenate((ends, at[cut]))
        order = np.argsort(ends, kind="stable")
        ends, upto = ends[order], np.concatenate((upto, cut))[order]
    return data, ends, upto, hashes


def _pieces(data: bytes, ends: np.ndarray) -> list[bytes]:
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they are the text. Without words they go with the one before."""
    data, ends, _, _ = _parsed(text)
    return [p.decode("utf-8", "surrogatepass") for p in _pieces(data, ends)] if len(ends) else []


def _powers(base: int, n: int) -> np.ndarray:
    if n <= len(_FEW.get(base, ())):
        return _FEW[base][:n]
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: The powers that most texts need.
_FEW: dict[int, np.ndarray] = {}
_FEW |= {b: _powers(b, 4096) for b in (*_BASES, *_BACK)}


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(start, end, hash, hash) of the spans of a text, in sentences, and the number of sentences."""
    _, _, upto, words = _parsed(text, whole=True)
    n = np.concatenate((np.zeros(1, dtype=np.int64), upto))
    k = len(upto)
    start = np.arange(k)
    end = np.maximum(np.searchsorted(n, n[:-1] + WORDS), start + RUN)
    # ends of no such run: the last start whose run is over by then begins the shortest that ends there
    over = np.zeros(k + 1, dtype=bool)
    over[end[end <= k]] = True
    late = np.flatnonzero(~over & (np.arange(k + 1) > end[0])) if k else end
    start, end = np.concatenate((start, np.searchsorted(end, late, side="right") - 1)), np.concatenate((end, late))
    on = end <= k
    start, end = start[on], end[on]
    found = []
    for seed, (base, back) in enumerate(zip(_BASES, _BACK, strict=True)):
        h = mix(words + np.uint64(seed))
        prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)))
        found.append(mix((prefix[n[end]] - prefix[n[start]]) * _powers(back, len(h) + 1)[n[start]] + (n[end] - n[start]).astype(np.uint64)).view(np.int64))
    return start, end, found[0], found[1], k


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("pos", pa.int32()), ("stop", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [spans(x.as_py()) for x in part.column(2)]
            offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32)
            flat = [np.concatenate([r[i] for r in rows]) for i in range(4)]
            held = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2]), pa.array(flat[3])], fields=list(item.value_type))
            n = pa.array([r[4] for r in rows], type=pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.ListArray.from_arrays(pa.array(offsets), held, type=item)], names=["doc_id", "content", "n", "spans"])


def places(docs: DataFrame) -> DataFrame:
    """doc_id, content (hash of the text), n (its sentences), pos, stop, h1, h2 of every span of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("content"), text_of("text").alias("text"))
    kinds = "doc_id long, content long, n int, spans array<struct<pos:int,stop:int,h1:long,h2:long>>"
    return rows.mapInArrow(_spans, kinds).select("doc_id", "content", "n", F.inline("spans"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, content, n, cut: for each row with a span its number of sentences, and the (pos, stop) of its repeated spans that are not at their first place."""
    every = written(places(docs), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("content").alias("content"), F.col("pos").alias("pos"))
    grouped = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    repeated = written(grouped.where(F.col("first") != F.col("final")).select("h1", "h2", "first"), "repeated", release=True)
    again = every.join(repeated, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "content", F.lit(None).cast("int").alias("n"), F.struct("pos", "stop").alias("span"))
    # a row with spans has one that starts at 0; max and collect_set leave nulls out
    all_rows = every.where("pos = 0").select("doc_id", "content", "n", F.lit(None).cast("struct<pos:int,stop:int>").alias("span"))
    found = again.union(all_rows).groupBy("doc_id", "content").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("span")).alias("cut"))
    return written(found, "cuts", release=True)


def without(text: str, cut: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(the text without the sentences under the spans, sentences, removed)."""
    data, ends, _, _ = _parsed(text)
    if not cut:
        return text, len(ends), 0
    gone = np.zeros(len(ends) + 1, dtype=np.int64)
    for a, b in cut:
        gone[a] += 1
        gone[b] -= 1
    out = np.cumsum(gone)[:-1] > 0
    left = b"".join([p for p, g in zip(_pieces(data, ends), out.tolist(), strict=True) if not g])
    return left.decode("utf-8", "surrogatepass"), len(ends), int(out.sum())


_CLEANED = pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])


def _cleaned(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """without() of each row; a null text is one to leave alone, and gives nulls."""
    rows = []
    for t, c in zip(texts, cuts, strict=True):
        if not t.is_valid:
            rows.append((None, None, None))
            continue
        cut = [(x["pos"], x["stop"]) for x in c.as_py() or ()]
        rows.append(without(t.as_py(), cut))
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _CLEANED, strict=True)], fields=list(_CLEANED))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, text (without removed sentences), n_sentences, n_removed of every row."""
    cut = removals(docs).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "n", "cut")
    rows = docs.select("doc_id", text_of("text").alias("text"))
    joined = rows.join(cut, rows["doc_id"].cast("long").eqNullSafe(cut["_id"]) & (F.xxhash64(rows["text"]) == cut["_content"]), "left")
    clean = F.arrow_udf(_cleaned, "struct<text:string,n_sentences:bigint,n_removed:bigint>")
    parsed = F.when(F.col("n").isNull() | (F.size("cut") > 0), F.col("text"))
    made = joined.select("doc_id", "text", "n", clean(parsed, "cut").alias("c"))
    numbers = [F.coalesce("c.n_sentences", F.col("n").cast("long")).alias("n_sentences"), F.coalesce("c.n_removed", F.lit(0).cast("long")).alias("n_removed")]
    return made.select("doc_id", F.coalesce("c.text", "text").alias("text"), *numbers)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

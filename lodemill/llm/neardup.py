"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct five-word shingles (words of ASCII-lower-cased text; a shorter document is
one shingle of all its words), kept as 64-bit hashes. The set's K minima make BANDS bands, whose hashes are
the bucket keys of candidate generation; of each minimum only the lowest B bits are retained, packed into
64-bit words, and the similarity of a candidate pair is estimated by XOR and bit counts, corrected for the
2^-B chance agreement. Pairs that may reach the threshold are confirmed on the full sets.

Hot groups. Equal sets are one node from the start (a partial aggregation), however many documents have
them. In a bucket, each node first meets only the bucket's star: the node whose buckets hold most, which in a
group of near copies is what they are copies of. So a large group costs a few pairs a member, and most of it
is one component after the first round. The second round pairs only nodes of different components, within
buckets that still hold several, and estimates these pairs by a finer signature of FINE one-bit minima made for
these nodes alone. In buckets of up to SMALL nodes all pairs are made, once each (in their first common bucket).
Larger ones hold texts with much in common, such as pages of one template, of which few are alike enough; their
nodes are put together, each with its rarest shingles, so many of them that two sets that reach the threshold
cannot lack a common one (an exact filter, whatever the order; the order is by counts in a table of SLOTS
counters). What a template gives to all pages is frequent, so it makes no pair unless it is most of the page.
Shingles of many nodes are dealt into tiles so that no task holds one. No link between components is skipped,
and links within a component change nothing.

A pair at the threshold itself is missed by all bands with probability (1 - 0.75^ROWS)^BANDS, 5e-6, and by
the estimate's margin of over four standard errors with about 1e-5.

Defined cases: null, empty and blank texts have the empty set (n_shingles 0) and are linked with nothing;
rows that repeat an id are each returned, rows without an id have the component of their equals (null if none
has an id) and never link different texts; an empty table gives an empty table; texts are read whole. Columns
other than doc_id and text are not read, and one_of_each() passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import FOLD, LOWER, UPPER, WORD, beside, hot_keys, mix, spread_join, text_of, whole, word_hashes
from lodemill.shared import written

SHINGLE, THRESHOLD = 5, 0.75
BANDS, ROWS, B = 32, 4, 4
K = BANDS * ROWS
#: How far below the threshold an estimate may be for its pair to be confirmed: over four standard errors.
MARGIN = 0.18
#: One-bit minima of the second round's signatures, and their margin: over four standard errors as well.
FINE, FINE_MARGIN = 2048, 0.065
#: Nodes of a bucket in which all pairs are made; nodes of a tile of a frequent shingle.
SMALL, TILE = 64, 256
#: Counters of shingles by hash, which give the order from rare to frequent: the bound on what the driver and each task hold.
SLOTS = 1 << 20
SEED = 20240229

_rng = np.random.default_rng(SEED)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 2**32, K, dtype=np.uint32) | np.uint32(1)
_C = _rng.integers(0, 2**32, K, dtype=np.uint32)
_FINE_A = _rng.integers(1, 2**32, FINE, dtype=np.uint32) | np.uint32(1)
_FINE_C = _rng.integers(0, 2**32, FINE, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, (ROWS,), dtype=np.uint64) | np.uint64(1)
_BAND_OWN = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()  # splits at ASCII white space
    if not words:
        return np.array([], dtype=np.uint64)
    h = word_hashes(words)
    n = len(h) - SHINGLE + 1
    if n < 1:
        return mix(np.array([(h * _PLACE[: len(h)]).sum() + np.uint64(len(h))], dtype=np.uint64))
    total = h[:n] * _PLACE[0]
    for i in range(1, SHINGLE):
        total += h[i : i + n] * _PLACE[i]
    return np.unique(mix(total))


def minima(s: np.ndarray, a: np.ndarray = _A, c: np.ndarray = _C) -> np.ndarray:
    """The least value of each permutation over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    step = 2**18 // len(a)
    for at in range(0, len(x), step):
        np.minimum(low, (x[at : at + step, None] * a + c).min(axis=0), out=low)
    return low


def fine(s: np.ndarray) -> np.ndarray:
    """FINE one-bit minima in 64-bit words."""
    bits = (mix(minima(s, _FINE_A, _FINE_C).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def fine_estimate(a: str, b: str) -> Column:
    """Similarity of two fine signatures: of one-bit minima, half the unequal ones agree by chance."""
    differ = sum((F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))) for i in range(1, FINE // 64)), F.bit_count(F.get(F.col(a), 0).bitwiseXOR(F.get(F.col(b), 0))))
    return 1 - differ * (2.0 / FINE)


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + _BAND_OWN).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest B bits of each minimum, after mixing, in 64-bit words."""
    bits = mix(low.astype(np.uint64)) & np.uint64(2**B - 1)
    per = 64 // B
    return (bits.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(B))).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: agreeing minima by bit counts, corrected for chance agreement."""
    ones = F.lit(int("1" * (64 // B), 2**B) if B != 4 else 0x1111111111111111).cast("long")

    def apart(i: int) -> Column:
        x = F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))
        for shift in (1, 2):  # any differing bit of a group of four shows in its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(ones))

    differ = sum((apart(i) for i in range(1, K * B // 64)), apart(0))
    chance = 2.0**-B
    return (1 - differ / float(K) - chance) / (1 - chance)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingles(text.as_py() or "")
            if len(s):
                h1, h2 = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64)
                low = minima(s)
                rows.append((doc_id, len(s), int(h1.view(np.int64)), int(h2.view(np.int64)), band_keys(low), packed(low)))
            else:
                rows.append((doc_id, 0, None, None, None, None))
        columns = list(zip(*rows, strict=True)) or [()] * len(_SIGNED)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits of the set), bands, bits of every row."""
    kinds = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(_sign, kinds)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of (node, text, doc_id) whose text is the node's; rows of one id stand together, and of these each node's first is enough."""
    last, seen = None, set()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            nodes, sets = [], []
            for node, text, doc_id in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                if doc_id != last:
                    last, seen = doc_id, set()
                if node in seen:
                    continue
                s = shingles(text.as_py() or "")
                if len(s) and int(mix(s).sum(dtype=np.uint64).view(np.int64)) == node:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(sets, type=pa.list_(pa.int64()))], names=["node", "shingles"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = [fine(x.values.to_numpy().view(np.uint64)) for x in batch.column(1)]
        sizes = pa.array([len(x.values) for x in batch.column(1)], type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, type=pa.list_(pa.int64())), sizes], names=["node", "fine", "n"])


def beside_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs(a, b), a written table, with what a(a, ...) and b(b, ...) have of their nodes; a node in very many pairs, as the star of a large
    group is, is dealt to several tasks."""
    total = pairs.count()
    hot = {x: hot_keys(pairs.groupBy(x).agg(F.count("*").alias("n")), x, total) for x in "ab"}
    return spread_join(spread_join(pairs, a, "a", hot["a"], "inner"), b, "b", hot["b"], "inner")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets reach the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    of = F.size("set_a") + F.size("set_b") - both
    percent = round(100 * threshold)
    return beside_pairs(pairs, a, b).where(both * 100 >= of * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): label is the least node reachable.

    Each round hooks every component onto its least neighbour, follows these links to their roots by doubling,
    and keeps the edges between different roots; all tables are written, none is collected.
    """
    left = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up"))
        up = written(up, "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            doubled = written(up.join(above, "up").select("node", F.col("higher").alias("up"), (F.col("up") != F.col("higher")).alias("moved")), "up")
            up = doubled.select("node", "up")
            if doubled.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            roots = up.select(F.col("node").alias("label"), F.col("up").alias("root"))
            labels = labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        labels = written(labels, "labels")
        ra, rb = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        left = written(left.join(ra, "a").join(rb, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot, n, low, high of (label, shingles): how many shingles of a slot there are, and the least and greatest label that has one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            held = batch.column(1).slice(at, 2048)
            sizes = np.diff(held.offsets.to_numpy())
            slots = _slots(held.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            labels = np.repeat(batch.column(0).slice(at, 2048).to_numpy(), sizes)
            order = np.lexsort((labels, slots))
            slots, labels = slots[order], labels[order]
            first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))[: len(slots)]
            last = np.concatenate((first[1:], [len(slots)])) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(slots[first].astype(np.int32)), pa.array((last - first + 1).astype(np.int64)), pa.array(labels[first]), pa.array(labels[last])], names=["slot", "n", "low", "high"])


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles of each slot are in sets(label, shingles), as a negative number where one label alone has them: one bounded array."""
    found = sets.select("label", "shingles").mapInArrow(_counted, "slot int, n long, low long, high long").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.select("slot", F.when(F.col("low") == F.col("high"), -F.least("n", F.lit(2**31 - 1))).otherwise(F.least("n", F.lit(2**31 - 1))).cast("int").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int32)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """shingle, node, label, n, at, short of sets(node, label, shingles): the rarest shingles by counts, `at` from 0, without
    those whose slot one label alone has, which link no components.

    A set of n with a partner at the threshold has at least percent n / 100 shingles in common with it, so one of
    the first n + 1 less that many; with a partner not smaller than itself, 2 percent n / (100 + percent): `short`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows: list[list[np.ndarray]] = []
                for node, label, held in zip(batch.column(0).slice(at, 512).to_pylist(), batch.column(1).slice(at, 512).to_pylist(), batch.column(2).slice(at, 512), strict=True):
                    s = held.values.to_numpy().view(np.uint64)
                    n = len(s)
                    own = counts[_slots(s)]
                    first = np.lexsort((s, np.abs(own)))[: n + 1 - -(-percent * n // 100)]
                    place = np.flatnonzero(own[first] > 0)
                    first, k, short = first[place], len(place), n + 1 - -(-2 * percent * n // (100 + percent))
                    rows.append([s[first].view(np.int64), np.full(k, node), np.full(k, label), np.full(k, n, dtype=np.int32), place.astype(np.int32), place < short])
                columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "label", "n", "at", "short"])

    return sets.select("node", "label", "shingles").mapInArrow(cut, "shingle long, node long, label long, n int, at int, short boolean")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of prefixes() rows: nodes of different labels that share a shingle and may reach the threshold from there on."""
    # of each shingle, the label that most of its nodes have, and how many nodes, and short ones, have it and have others
    each = rows.groupBy("shingle", "label").agg(F.count("*").alias("n"), F.count_if("short").alias("s"))
    largest = F.struct("n", "label")
    per = each.groupBy("shingle").agg(F.max_by("label", largest).alias("main"), F.max("n").alias("n_main"), F.max_by("s", largest).alias("s_main"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > n_main AND s > 0")
    tiles = lambda c: F.ceil(c / TILE).cast("int")
    per = per.select("shingle", "main", tiles(F.col("n_main")).alias("t_main"), tiles(F.col("s_main")).alias("st_main"), tiles(F.col("n") - F.col("n_main")).alias("t_rest"), tiles(F.col("s") - F.col("s_main")).alias("st_rest"))
    rows = written(rows.join(written(per, "shingles"), "shingle").withColumn("in_main", F.col("label") == F.col("main")), "rare")
    dealt = lambda over: F.pmod(F.xxhash64("node"), F.greatest(F.col(over), F.lit(1))).cast("int")
    cells = lambda kind, own, other, first: F.transform(F.filter(F.sequence(F.lit(-1), F.col(other) - 1), lambda k: k >= 0), lambda k: F.struct(F.lit(kind).alias("kind"), (own if first else k).alias("i"), (k if first else own).alias("j")))
    # nodes of the main label meet the rest (kind 0 and, the other way, 1), and the rest meets itself (kind 2); short rows of a tile i meet all of a tile j
    of_a = F.when(F.col("in_main"), cells(0, dealt("st_main"), "t_rest", True)).otherwise(F.concat(cells(1, dealt("st_rest"), "t_main", True), cells(2, dealt("st_rest"), "t_rest", True)))
    of_b = F.when(F.col("in_main"), cells(1, dealt("t_main"), "st_rest", False)).otherwise(F.concat(cells(0, dealt("t_rest"), "st_main", False), cells(2, dealt("t_rest"), "st_rest", False)))
    side = lambda x: [F.col("shingle"), F.col("c.kind").alias("kind"), F.col("c.i").alias("i"), F.col("c.j").alias("j"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "at")]]
    a, b = rows.where("short").withColumn("c", F.explode(of_a)).select(side("a")), rows.withColumn("c", F.explode(of_b)).select(side("b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    reach = (100 + percent) * rest >= percent * (F.col("n_a") + F.col("n_b"))
    fits = (F.col("label_a") != F.col("label_b")) & smaller & (100 * F.col("n_a") >= percent * F.col("n_b")) & reach
    return a.join(b, ["shingle", "kind", "i", "j"]).where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def between(members: DataFrame, labels: DataFrame, sets: DataFrame, bands: DataFrame, threshold: float, margin: float = FINE_MARGIN) -> DataFrame:
    """(a, b), a < b, nodes of different components that share a bucket, whose finer estimate is at most `margin` below the threshold."""
    percent = round(100 * threshold)
    placed = members.join(labels, "node", "left").select("key", "band", "node", "members", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    inside = written(placed.join(mixed, "key", "left_semi"), "inside")
    finer = written(sets.join(inside.select("node").distinct(), "node").mapInArrow(_fine, "node long, fine array<long>, n long"), "finer")
    a, b = (finer.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "fine", "n")]) for x in "ab")
    close = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (fine_estimate("fine_a", "fine_b") >= threshold - margin)

    small = written(inside.where(F.col("members") <= SMALL).join(finer, "node").join(bands, "node"), "inside")
    side = lambda x: [F.col("key"), F.col("band").alias(f"band_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "fine", "n", "bands")]]
    # of their common buckets the first one makes the pair; if it is a large one, the pair is made below
    earliest = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("band_a") + 1
    apart = (F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b"))
    near = small.select(side("a")).join(small.select(side("b")), "key").where(apart & close & earliest).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    large = written(sets.join(inside.where(F.col("members") > SMALL).select("node", "label").distinct(), "node"), "large")
    if large.isEmpty():
        return near
    found = prefix_pairs(prefixes(large, frequencies(large), percent), percent)
    far = found.join(a.withColumnRenamed("node_a", "a"), "a").join(b.withColumnRenamed("node_b", "b"), "b").where(close).select("a", "b")
    return near.unionByName(far).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    signed = written(signatures(docs), "signatures")
    nodes = written(
        signed.where("n_shingles > 0").groupBy(F.col("h1").alias("node"), "h2")
        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"), F.count("*").alias("rows")),
        "nodes",
    )
    named = nodes.where(F.col("doc_id").isNotNull())
    keyed = named.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(keyed.join(sizes, "key").select("key", "band", "node", "members"), "shared")
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    stars = shared.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("star"))
    members = written(shared.join(stars, "key").select("key", "band", "node", "star", "members"), "members")

    bits = named.select("node", "bits", "n")
    bits_a, bits_b = (bits.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    likely = (estimate("bits_a", "bits_b") >= threshold - MARGIN) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    # first round: each node with the stars of its buckets
    met = written(members.where("node != star").select(F.col("node").alias("a"), F.col("star").alias("b")).distinct(), "met")
    first = written(beside_pairs(met, bits_a, bits_b).where(likely).select("a", "b"), "pairs")
    touched = members.select("node").distinct().join(named.select("node", "doc_id"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    sets = written(texts.join(touched, "doc_id").select("node", "text", "doc_id").mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    labels = components(written(confirmed(first, sets, threshold), "links"))

    # second round: pairs of different components
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = written(between(members, labels, sets, named.select("node", "bands"), threshold).join(tested, ["a", "b"], "left_anti"), "pairs")
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    joined = confirmed(met, sets, threshold).join(la, "a", "left").join(lb, "b", "left")
    merged = components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    # labels of the first round, then what the second made of them (or of nodes that had none)
    up = merged.select(F.col("node").alias("old"), F.col("label").alias("new"))
    old = labels.unionByName(merged.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti")).select("node", F.col("label").alias("old"))
    final = written(old.join(up, "old", "left").select("node", F.coalesce("new", "old").alias("label")).join(named.select("node", "doc_id"), "node"), "labels")

    # the least id of a component, and so of each node, and so of each row; the rows of hot nodes and the nodes of hot components are dealt out
    each = written(final.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    total = each.agg(F.sum("n")).first()[0] or 0
    linked = written(spread_join(final.select("node", "label"), each.select("label", "component_id"), "label", hot_keys(each, "label", total)).select("node", "component_id"), "linked")
    of = written(nodes.select("node", "doc_id", "rows").join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("rows").alias("n")), "of")
    total = of.agg(F.sum("n")).first()[0] or 0
    bare = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = spread_join(signed.where("n_shingles > 0").select("doc_id", "n_shingles", F.col("h1").alias("node")), of.select("node", "component_id"), "node", hot_keys(of, "node", total))
    return rows.select("doc_id", "n_shingles", "component_id").unionByName(bare)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each component one row stays, the least by (doc_id, nulls last, content).

    Rows are told apart by their text's hash, so different texts under one id, or without an id, are judged apart
    and equal ones as one. Texts without shingles are like no other; one row of each id and text stays (of rows that
    differ in other columns only, the least by a hash of these).
    """
    content, doc_id = F.xxhash64(text_of("text")), F.col("doc_id").cast("long")
    texts = written(docs.select(content.alias("doc_id"), text_of("text").alias("text")).groupBy("doc_id").agg(F.first("text").alias("text"), F.count("*").alias("n")), "texts")
    found = near_duplicates(texts, threshold).select(F.col("doc_id").alias("content"), "component_id", (F.col("n_shingles") == 0).alias("bare"))
    total = texts.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(texts.select(F.col("doc_id").alias("content"), "n"), "content", total)
    rows = spread_join(docs.select(doc_id.alias("id"), content.alias("content")), found, "content", hot)
    each = rows.groupBy("component_id", F.when(F.col("bare"), F.col("id")).alias("alone"), "id", "content").agg(F.count("*").alias("n"))
    kept = each.groupBy("component_id", "alone").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "content", "n")).alias("k"))
    kept = kept.select(F.col("k.id").alias("kept_id"), F.col("k.content").alias("kept_content"), F.col("k.n").alias("n")).hint("merge")
    packed = beside(docs, id=doc_id, content=content)
    # both branches below read the same columns up to here, so the rows are dealt out once; of equal id and content there are seldom several
    joined = packed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("content") == F.col("kept_content")))
    single = joined.where("n = 1").select("row")
    others = [F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    several = joined.where("n > 1").groupBy("id", "content").agg(F.min_by("row", order).alias("row")).select("row")
    return whole(single.unionByName(several))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP3_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.node = d.doc_id
"""

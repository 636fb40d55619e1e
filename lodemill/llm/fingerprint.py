"""Document fingerprints: a Merkle tree over the leaves, paragraphs and sections of a text.

Paragraphs are lines; their leaves are sentences (short ones go with the next, long ones are cut after words that a hash of the word
alone picks, so an edit moves no other cut); sections are runs of paragraphs that end where a paragraph's
own hash says so. Every node's hash covers its children's, so two roots are equal exactly if the texts
are, and a comparison descends only into branches whose hashes differ.

A fingerprint is a string that holds the tree:
    root=section|section, section: hash:paragraph;paragraph, paragraph: hash~leaf,leaf, leaf: hash.length
The root is SHA-256, inner hashes are cut to 10 hex digits and leaves to 8. Two trees are compared from the root
down: equal sections are matched (each once), then equal paragraphs of the sections that are left, then equal leaves
of the paragraphs that are left. Likeness is the Dice share of code points in what is matched; leaves of the one that
are not matched are where it was edited.

Null counts as the empty text; its tree has no section, two empty texts are alike (1.0), an empty and any
other text are not (0.0). Texts of any length are read whole. Equal rows get equal fingerprints.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import ceil
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.llm.common import text_of, unused

#: Code points that a leaf has at least before its sentence's end, and from which on it is cut further; one word in so many ends such a cut; one paragraph in so many ends a section.
SHORT_LEAF, LONG_LEAF, CUT_EVERY, SECTION_EVERY = 40, 160, 8, 4
#: Rows of a block of neighbours by id, and the most blocks: the bound on what the driver holds (one id each).
BLOCK_ROWS, MOST_BLOCKS = 1_000, 50_000

_LEAF = re.compile(rf"(?s).{{{SHORT_LEAF},}}?[.!?|]+\s*|.+")
_WORD = re.compile(r"\S+\s*|\s+")


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(paragraph: str) -> list[str]:
    out: list[str] = []
    for leaf in _LEAF.findall(paragraph):
        if len(leaf) <= LONG_LEAF:
            out.append(leaf)
            continue
        held: list[str] = []
        for word in _WORD.findall(leaf):
            held.append(word)
            if crc32(word.strip().encode("utf-8", "surrogatepass")) % CUT_EVERY == 0:
                out.append("".join(held))
                held = []
        if held:
            out.append("".join(held))
    return out


def tree(text: str) -> str:
    """The fingerprint of one text."""
    lines = text.split("\n")
    paragraphs = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    sections: list[str] = []
    section_hashes: list[bytes] = []
    shown: list[str] = []
    hashes: list[bytes] = []

    def close() -> None:
        section_hashes.append(_hash(b"s" + b"".join(hashes)))
        sections.append(f"{section_hashes[-1].hex()[:10]}:{';'.join(shown)}")
        shown.clear()
        hashes.clear()

    for p in paragraphs:
        leaves = _leaves(p)
        own = [_hash(x.encode("utf-8", "surrogatepass")) for x in leaves]
        h = _hash(b"p" + b"".join(own))
        hashes.append(h)
        shown.append(f"{h.hex()[:10]}~" + ",".join([f"{d.hex()[:8]}.{len(x)}" for d, x in zip(own, leaves, strict=True)]))
        if h[-1] % SECTION_EVERY == 0:
            close()
    if shown:
        close()
    return f"{hashlib.sha256(b'r' + b''.join(section_hashes)).hexdigest()}={'|'.join(sections)}"


Tree = list[tuple[str, list[tuple[str, list[str]]]]]


def _parsed(fingerprint: str) -> Tree:
    """(hash, paragraphs) of each section; a paragraph is (hash, leaves)."""
    return [(x[:10], [(p[:10], p[11:].split(",")) for p in x[11:].split(";")]) for x in fingerprint[65:].split("|") if x]


def _size(leaf: str) -> int:
    return int(leaf[9:])


def _unmatched(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(start, end) in code points of a's leaves that find no match in b, descending only into branches that differ."""
    sections = Counter(h for h, _ in b)
    left_a, at = [], 0
    for h, paragraphs in a:
        if sections[h] > 0:
            sections[h] -= 1
            at += sum(_size(x) for _, leaves in paragraphs for x in leaves)
            continue
        for p in paragraphs:
            left_a.append((at, p))
            at += sum(map(_size, p[1]))
    # b's sections that are still there, from the first on
    left_b = []
    for h, paragraphs in b:
        if sections[h] > 0:
            sections[h] -= 1
            left_b += paragraphs
    held = Counter(h for h, _ in left_b)
    leaves_a = []
    for at, (h, leaves) in left_a:
        if held[h] > 0:
            held[h] -= 1
            continue
        for x in leaves:
            leaves_a.append((at, x))
            at += _size(x)
    spare: Counter[str] = Counter()
    for h, leaves in left_b:
        if held[h] > 0:
            held[h] -= 1
            spare.update(leaves)
    out: list[tuple[int, int]] = []
    for at, x in leaves_a:
        if spare[x] > 0:
            spare[x] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + _size(x))
        else:
            out.append((at, at + _size(x)))
    return out


def _length(tree: Tree) -> int:
    return sum(_size(x) for _, paragraphs in tree for _, leaves in paragraphs for x in leaves)


def compared(a: str, b: str) -> tuple[float, list[tuple[int, int]]]:
    """(likeness, spans of a that b lacks) of two fingerprints."""
    if a[:64] == b[:64]:
        return 1.0, []
    x, y = _parsed(a), _parsed(b)
    spans, n, m = _unmatched(x, y), _length(x), _length(y)
    return 2.0 * (n - sum(e - s for s, e in spans)) / (n + m), spans


def alike(a: str, b: str) -> float:
    """Dice share of code points in matched branches."""
    return compared(a, b)[0]


def edits(a: str, b: str) -> list[dict[str, int]]:
    """Spans (code points) of a's leaves that b lacks."""
    return [{"start": s, "end": e} for s, e in compared(a, b)[1]]


def fingerprint(text: str | Column) -> Column:
    """The fingerprint of a text column."""

    def trees(column: pa.Array) -> pa.Array:
        return pa.array([tree(x.as_py()) for x in column], type=pa.string())

    return F.arrow_udf(trees, "string")(text_of(text))


def comparison(a: str | Column, b: str | Column) -> Column:
    """struct<likeness: double, edits: array<struct<start:int,end:int>>> of two columns of fingerprints: how alike they are, and
    where the first text has leaves that the second lacks; null with a null."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scores(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = [None if p is None or q is None else compared(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        likeness = pa.array([r and r[0] for r in rows], type=pa.float64())
        where = pa.array([r and [{"start": s, "end": e} for s, e in r[1]] for r in rows], type=spans)
        return pa.StructArray.from_arrays([likeness, where], names=["likeness", "edits"], mask=pa.array([r is None for r in rows]))

    return F.arrow_udf(scores, "struct<likeness:double,edits:array<struct<start:int,end:int>>>")(a, b)


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", tie: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with next_<column>: the columns' values of the next row by descending key; after the last comes the first.

    Rows are dealt into blocks of neighbours whose borders are quantiles of the key (at most MOST_BLOCKS of
    them: all that the driver sees), and each block's highest row also stands, as a ghost, at the end of the
    block above, so each block finds its neighbours alone. Equal keys stand by the tie column; null keys come
    last; if no row has a key the last row's next is null. A column of docs that has such a name is replaced.
    """
    n = docs.select(F.count(key)).first()[0]
    blocks = max(1, min(MOST_BLOCKS, ceil(n / block_rows)))
    share = [(i + 1) / blocks for i in range(blocks)]
    row = docs.agg(F.percentile_approx(key, share, 10 * min(blocks, 10_000) + 1000).alias("q"), F.max(key).alias("top")).first()
    tops = sorted({*(row["q"] or []), *([] if row["top"] is None else [row["top"]])})
    tops = [x for x in tops if x is not None]
    bounds = F.lit(tops) if tops else F.array().cast("array<bigint>")
    steps = [2**i for i in reversed(range(max(1, len(tops).bit_length())))]
    # the number of tops below the key, by binary search
    below = F.aggregate(F.lit(steps), F.lit(0), lambda acc, s: F.when(F.get(bounds, acc + s - 1) < F.col(key), acc + s).otherwise(acc))
    block = F.coalesce(below, F.lit(0))
    places = F.when(F.get(bounds, block) == F.col(key), F.array(F.struct(block.alias("block"), F.lit(False).alias("ghost")), F.struct(((block + 1) % max(1, len(tops))).alias("block"), F.lit(True).alias("ghost"))))
    places = F.coalesce(places, F.array(F.struct(block.alias("block"), F.lit(False).alias("ghost"))))
    (place,) = unused(docs, "place")
    placed = docs.withColumn(place, F.explode(places))
    ghost = F.col(place)["ghost"]
    order = Window.partitionBy(F.col(place)["block"]).orderBy(ghost, F.col(key).desc_nulls_last(), F.col(tie))
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~ghost).drop(place)


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, its edited text and the next document by their fingerprints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of("text").alias("text"))
    # fingerprints are made after the shuffle: a second tree of each text costs less than moving the trees
    near = with_next(docs, ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    after = F.coalesce("next_text", F.lit(""))
    edited = near.select("doc_id", n.cast("long").alias("n_chars"), fingerprint("text").alias("fingerprint"), fingerprint(after).alias("next_fingerprint"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(after, F.lit(1), half)).alias("edited"))
    both = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint("edited").alias("edited_fingerprint"))
    scored = both.select("*", comparison("fingerprint", "edited_fingerprint").alias("e"), comparison("fingerprint", "next_fingerprint").alias("n"))
    spans = F.array_join(F.transform("e.edits", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("e.likeness").alias("near_edited"), F.col("n.likeness").alias("near_next"), spans.alias("edited_spans"))

"""Conversations as one trie of their prefixes, as chains of nodes that one conversation owns.

A node is a distinct sequence of the first d turns; its members are the conversations that start with it and its
owner is the least of them. Down a conversation's own path ownership changes once: from the first depth on at which
it is the least member it is so at every depth. That depth is found by binary search, for all conversations at once:
every round joins the digests of a few depths in the middle of what is open to the table of prefix-digest minima
(two levels of the search a round). The nodes a conversation owns are its chain; the node above the first one belongs
to the chain it hangs from, so the chains are a tree with far fewer rows than the trie.

Chains are added up from below: members, leaves, words of whole conversations and words of the chains' own nodes are
sums over a chain and all that hang below it, found by doubling (after k rounds a chain holds what is less than 2^k
chains below), so a deep tree takes a logarithm of its height in rounds. A node's own figures are what hangs from its
chain at its depth or deeper, a running sum up the chain. With a node's n members, the sum over its subtree of
(members - 1) * words follows from the words its members read below it less the words of the subtree's nodes.

Digests are 128 bits: the exclusive or of hashes of (place, turn), so a prefix's digest is a running fold, and a
conversation with most of all turns is many tasks (operators/scan.py). Turns are told apart by 128 bits of SHA-256.
Only digests and counts are shuffled, never texts. Joins on a conversation or prefix with many rows are salted.

Turns are in order of turn (null first), those of one turn in order of the digest of role and text (equal ones count
each). A null role or text is empty. Rows without conv_id belong to no conversation. No conversations: no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import WORD, hot_keys, spread_join, text_of
from lodemill.llm.mixing import n_words
from lodemill.operators.scan import scanned
from lodemill.shared import kept, scratch, written

#: Conversations of which one gives the others their first turns, and fewer than so many turns are given.
FAMILY, GIVEN = 20, 4
#: Members of a node in one piece of the list that is hashed.
PIECE = 50_000


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, words of every turn in order."""
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    narrow = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), n_words("text").alias("words"))
    # written before it is dealt out by ranges, which looks at it once for the bounds and once for the rows
    return scanned(written(narrow, "digests"), ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], at="place").select("conv_id", "place", "digest", "words")


def hot_conversations(counts: DataFrame) -> DataFrame:
    return hot_keys(counts, "conv_id", counts.agg(F.sum("n")).first()[0] or 0)


def with_given_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of rebuilt conversations: the first h turns of c - c % 20, then c's own after its first h; h = crc32(decimal c) % 4.

    A conversation is conv_id, n (turns); there is one for every conv_id, also where no turn is left."""
    c = F.col("conv_id")
    counts = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    giving = counts.where(c % FAMILY == 0).select(c.alias("base"), F.col("n").alias("there"))
    own = counts.select(c, "n", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string")) % GIVEN).alias("h")).join(giving, "base", "left")
    rule = written(own.select(c, "base", "n", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("given")), "rule")
    after = spread_join(turns, rule.select("conv_id", "h", "given"), "conv_id", hot_conversations(counts), "inner").where(F.col("place") > F.col("h"))
    heads = turns.where((c % FAMILY == 0) & (F.col("place") < GIVEN)).select(c.alias("base"), "place", "digest", "words")
    before = rule.where("given > 0").select("conv_id", "base", "given").join(heads, "base").where("place <= given")
    columns = ["conv_id", "place", "digest", "words"]
    every = after.withColumn("place", F.col("place") - F.col("h") + F.col("given")).select(*columns).unionByName(before.select(*columns))
    return every, rule.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def prefixes_of(turns: DataFrame) -> DataFrame:
    """conv_id, depth, prefix (128 bits), words (of the last turn), read (of all turns so far)."""
    halves = {"a": F.xxhash64(F.lit(1), "place", "digest"), "b": F.xxhash64(F.lit(2), "digest", "place")}
    folded = scanned(turns, ["conv_id"], ["place"], a=("xor", halves["a"]), b=("xor", halves["b"]), read=("sum", F.col("words")))
    return folded.select("conv_id", F.col("place").alias("depth"), F.struct("a", "b").alias("prefix"), "words", "read")


def first_owned(prefixes: DataFrame, convs: DataFrame, least: int) -> DataFrame:
    """conv_id, n, first, parent, at: the first depth that a conversation owns (n + 1: none), and the node above it.

    The least conversation owns the root, depth 0, and has no parent."""
    minima = written(prefixes.groupBy("prefix").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")), "minima")
    hot = hot_keys(minima, "prefix", minima.agg(F.sum("n")).first()[0] or 0)
    owners = minima.select("prefix", "owner")
    others = convs.where(F.col("conv_id") != least)
    # at `low` another one owns the conversation's path, at `high` it does itself, or is at its end
    state = others.select("conv_id", "n", F.lit(0).cast("long").alias("low"), F.lit(least).cast("long").alias("owner"), (F.col("n") + 1).alias("high"))
    open_, done = state.where("high - low > 1"), [state.where("high - low <= 1")]
    while True:
        middle = F.shiftright(F.col("low") + F.col("high"), 1)
        asked = F.array(middle, F.shiftright(F.col("low") + middle, 1), F.shiftright(middle + F.col("high"), 1))
        inside = F.array_distinct(F.filter(asked, lambda d: (d > F.col("low")) & (d < F.col("high"))))
        probes = open_.select("*", F.explode(inside).alias("depth")).join(prefixes.select("conv_id", "depth", "prefix"), ["conv_id", "depth"])
        answers = spread_join(probes, owners.withColumnRenamed("owner", "found"), "prefix", hot, "inner")
        mine = F.col("found") == F.col("conv_id")
        lower = F.max(F.when(~mine, F.struct("depth", F.col("found").alias("owner"))))
        new = answers.groupBy("conv_id").agg(F.first("n").alias("n"), F.max(F.struct("low", "owner")).alias("was"), lower.alias("is"), F.least(F.min("high"), F.min(F.when(mine, F.col("depth")))).alias("high"))
        state = written(new.select("conv_id", "n", F.coalesce("is.depth", "was.low").alias("low"), F.coalesce("is.owner", "was.owner").alias("owner"), "high"), "search")
        open_, ended = state.where("high - low > 1"), state.where("high - low <= 1")
        done.append(ended)
        if open_.isEmpty():
            break
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    found = every.select("conv_id", "n", F.col("high").alias("first"), F.col("owner").alias("parent"), F.col("low").alias("at"))
    root = convs.where(F.col("conv_id") == least).select("conv_id", "n", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("at"))
    return written(found.unionByName(root), "owned")


SUMS = ["convs", "leaves", "read", "own"]


def summed_up(chains: DataFrame) -> DataFrame:
    """chains(conv_id, up, and SUMS) with the sums over the chain and all below it, by doubling."""
    state = written(chains.select("conv_id", "up", *SUMS), "doubling")
    while not (hanging := state.where("up IS NOT NULL")).isEmpty():
        below = hanging.groupBy("up").agg(*[F.sum(c).alias(f"below_{c}") for c in SUMS], F.count("*").alias("n"))
        below = written(below, "below")
        hot = hot_keys(below.withColumnRenamed("up", "_up"), "_up", below.agg(F.sum("n")).first()[0] or 0)
        next_up = spread_join(hanging.select("conv_id", F.col("up").alias("_up")), state.select(F.col("conv_id").alias("_up"), F.col("up").alias("next")), "_up", hot)
        more = state.join(below.drop("n").withColumnRenamed("up", "conv_id"), "conv_id", "left").join(next_up.select("conv_id", "next"), "conv_id", "left")
        state = written(more.select("conv_id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"below_{c}", F.lit(0))).alias(c) for c in SUMS]), "doubling")
    return state.select("conv_id", *SUMS)


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of turns(conv_id, place, digest, words) and conversations(conv_id, n).

    nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; ends: conv_id, depth of the node at
    which a conversation, `member`, ends."""
    spark = turns.sparkSession
    least = convs.agg(F.min("conv_id")).first()[0]
    if least is None:
        nodes = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
        return spark.createDataFrame([], nodes), spark.createDataFrame([], "conv_id long, depth long, member long")
    prefixes = written(prefixes_of(turns), "prefixes")
    owned = first_owned(prefixes, convs, least)
    hot = hot_conversations(convs)
    marked = spread_join(prefixes.select("conv_id", "depth", "words", "read"), owned.select("conv_id", "n", "first", "parent"), "conv_id", hot, "inner")
    words = marked.groupBy("conv_id").agg(F.sum("words").alias("read"), F.sum(F.when(F.col("depth") >= F.col("first"), F.col("words")).otherwise(0)).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    placed = written(owned.join(words, "conv_id", "left").select("conv_id", "n", "first", "parent", "at", zero("read"), zero("own")), "placed")
    chains, guests = placed.where("first <= n"), placed.where("first > n")
    # what a chain holds by itself: its conversation, those that end in its nodes without a chain, a leaf unless a chain goes on from its end
    visits = guests.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("convs"), F.sum("read").alias("visiting"))
    went_on = chains.where("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), F.col("at").alias("n"), F.lit(1).alias("on")).distinct()
    held = chains.join(visits, "conv_id", "left").join(went_on, ["conv_id", "n"], "left")
    own = held.select(
        "conv_id", F.col("parent").alias("up"), (F.coalesce("convs", F.lit(0)) + 1).alias("convs"), F.when(F.col("on").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        (F.col("read") + F.coalesce("visiting", F.lit(0))).alias("read"), "own",
    )
    totals = summed_up(own)
    hanging = chains.where("parent IS NOT NULL").select("conv_id", "parent", "at").join(totals, "conv_id").select("parent", "at", *SUMS, F.lit(1).cast("long").alias("chains"))
    none = F.lit(0).cast("long")
    visiting = guests.select("parent", "at", F.lit(1).cast("long").alias("convs"), none.alias("leaves"), "read", none.alias("own"), none.alias("chains"))
    held_at = hanging.unionByName(visiting).groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*[F.sum(c).alias(f"at_{c}") for c in [*SUMS, "chains"]])
    top = chains.where("parent IS NULL").select("conv_id", none.alias("depth"), none.alias("words"), none.alias("read"), "n", "first", "parent")
    nodes = marked.where(F.col("depth") >= F.col("first")).select(*top.columns).unionByName(top).join(held_at, ["conv_id", "depth"], "left")
    tip = (F.col("depth") == F.col("n")) & (F.coalesce("at_chains", none) == 0)
    folds = {"s_convs": F.coalesce("at_convs", none), "s_leaves": F.coalesce("at_leaves", none) + tip.cast("long"), "s_more": F.coalesce(F.col("at_read") - F.col("at_own"), none)}
    up = scanned(nodes, ["conv_id"], [F.col("depth").desc()], **{n: ("sum", c) for n, c in folds.items()})
    out = up.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), (F.col("s_convs") + 1).alias("n_convs"),
        (F.coalesce("at_chains", none) + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"), F.col("s_leaves").alias("n_leaves"),
        (F.col("s_more") - F.col("s_convs") * (F.col("read") - F.col("words"))).alias("saved_tokens"),
    )
    ends = chains.select("conv_id", F.col("n").alias("depth"), F.col("conv_id").alias("member")).unionByName(guests.select(F.col("parent").alias("conv_id"), F.col("at").alias("depth"), F.col("conv_id").alias("member")))
    return out, ends


def list_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of the members of each node, in decimal, ascending, joined by commas.

    Members are sorted in ranges, which may split a node, and written out in pieces of text; a node's pieces are then hashed
    one after the other as they come, so that no task holds a node's members."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, held = ["conv_id", "depth", "start", "text"], None, []
        for batch in batches:
            out: list[tuple] = []
            for conv, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and ((conv, depth) != key or len(held) >= piece):
                    out.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = (conv, depth)
                held.append(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, held[0], ",".join(map(str, held)))], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, sha = ["conv_id", "depth", "ends_sha256"], None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (conv, depth) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (conv, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=names)

    order = ["conv_id", "depth", "member"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, start long, text string")
    dealt = cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "start")
    return dealt.mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        turns = written(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
        every, convs = with_given_turns(turns)
        nodes, ends = trie(every, written(convs, "convs"))
        hashes = list_hashes(ends)
        nothing = hashlib.sha256().hexdigest()
        out = nodes.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
        return kept(out, "trie")


#: CRC-32 of a conversation's decimal id, bit by bit: SQL has no such function.
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"
)
OP11_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, len(regexp_extract_all(text, '{WORD}')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS r FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {GIVEN} AS h, count(*) AS n FROM o GROUP BY conv_id),
g AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS given FROM c LEFT JOIN c b ON b.conv_id = c.base),
s AS (SELECT g.conv_id, r AS d, k, words FROM g JOIN o ON o.conv_id = g.base AND o.r <= g.given
    UNION ALL SELECT g.conv_id, r - h + given, k, words FROM g JOIN o ON o.conv_id = g.conv_id AND o.r > g.h),
p AS (SELECT conv_id, coalesce(list(k ORDER BY d) FILTER (d IS NOT NULL), []) AS path, coalesce(list(words ORDER BY d) FILTER (d IS NOT NULL), []) AS words FROM c LEFT JOIN s USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, d AS depth, array_to_string(path[1:d], ',') AS node, array_to_string(path[1:d - 1], ',') AS above, len(path) = d AS ended, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
    FROM p, unnest(range(len(path) + 1)) AS x(d)),
nodes AS (SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY node, depth),
kids AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth),
sub AS (SELECT array_to_string(string_split(node, ',')[1:d], ',') AS node, d AS depth, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM full_nodes, unnest(range(depth + 1)) AS x(d) GROUP BY ALL)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sub s ON s.node = n.node AND s.depth = n.depth LEFT JOIN nodes a ON n.depth > 0 AND a.node = n.above AND a.depth = n.depth - 1
"""

"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256), so equal texts at any number of paths are one
blob. The ledger holds, for each blob, which rule versions have scanned it and what they found. A scan takes
the blobs of the given paths, drops all (blob, rule version) pairs in the ledger, runs each rule over the
blobs that it has not seen, appends to the ledger and joins the findings back to all paths.

Rules are regular expressions. A rule's matches are leftmost and do not overlap; matches that are too short
are dropped after matching. Positions come from the texts between matches: splitting by the same pattern gives
one piece more than there are matches, and running sums of lengths give offsets in code points (and in bytes, for
cutting). The running sums are taken by doubling, so a text of n matches costs n log n.

Main path: DataFrame expressions only. Copies are dropped before anything is scanned, and by a partial
aggregation before the shuffle, so a blob with very many paths moves once for each task at most; on the way back
the paths of such blobs are dealt to many tasks.

A null text counts as empty; empty texts and empty tables have no findings; repeated paths each get the
findings of their text; other columns of the input are not read, and redact() passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import beside, hot_keys, spread_join, text_of, whole
from lodemill.shared import written


@dataclass(frozen=True)
class Rule:
    """least: characters that the group has at least, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules in their order, then further ones; spans of one start are listed in this order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a maximal run of 16 or more, as a run and a later test for length give
)
RULES = (
    *BASE,
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: A private key from its first line to its last or, where that is missing, over the lines of headers and base64 that follow.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    r"|[ \t]*[A-Za-z0-9+/=]*(?:[ \t\r]*\n[ \t]*(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/=]*)(?=[ \t\r]*(?:\n|\z)))*+)"
)
#: What is masked: RULES (whose pem, as in the SQL of the scan, finds a key's first line), with keys as a whole.
MASKED = (*[r for r in RULES if r.kind != "pem"], Rule("pem", KEY_BLOCK, version=2))
LEDGER = "blob string, rules array<string>, spans array<struct<kind:string,start:int,end:int,from:int,to:int>>"
#: start and end in code points, from and to in bytes of UTF-8.
SPAN = "array<struct<kind:string,start:int,end:int,from:int,to:int>>"


def running(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Each element of an array combined with all before it, by doubling: n log n steps. start: what adds nothing."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda v, i: add(v, F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), start))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(rule: Rule, text: Column, matches: Column) -> Column:
    """Spans of a rule's matches that are long enough."""
    pieces = F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else matches
    none = F.lit(0)
    size = lambda x, f: F.coalesce(f(x), none)
    steps = F.zip_with(pieces, matches, lambda p, m: F.struct((F.length(p) + size(m, F.length)).alias("n"), (F.octet_length(p) + size(m, F.octet_length)).alias("b")))
    nothing = F.struct(none.alias("n"), none.alias("b"))
    ends = running(steps, nothing, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["b"] + y["b"]).alias("b")))
    parts = F.filter(F.arrays_zip(ends.alias("end"), matches.alias("match"), held.alias("held")), lambda x: F.length(x["held"]) >= rule.least)

    def span(x: Column) -> Column:
        n, b = x["end"]["n"], x["end"]["b"]
        return F.struct(F.lit(rule.kind).alias("kind"), (n - F.length(x["match"])).alias("start"), n.alias("end"), (b - F.octet_length(x["match"])).alias("from"), b.alias("to"))

    return F.transform(parts, span)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs(blob, text, unseen): each rule runs where its key is in unseen."""
    none = F.array().cast("array<string>")
    due = lambda r: F.array_contains("unseen", r.key)
    matched = blobs.select("*", *[F.when(due(r), F.regexp_extract_all("text", F.lit(r.pattern), 0)).otherwise(none).alias(f"m_{r.kind}") for r in rules])
    spans = [F.when(F.size(f"m_{r.kind}") > 0, _spans(r, F.col("text"), F.col(f"m_{r.kind}"))).otherwise(F.array().cast(SPAN)) for r in rules]
    return matched.select("blob", F.col("unseen").alias("rules"), F.concat(*spans).alias("spans"))


def content(docs: DataFrame) -> DataFrame:
    """doc_id, blob, text: each path's content address."""
    return docs.select("doc_id", text_of("text").alias("text")).withColumn("blob", F.sha2("text", 256))


def hot_blobs(paths: DataFrame) -> DataFrame:
    """Blobs with more than a thousandth of all paths(blob): fewer than a thousand."""
    counts = written(paths.groupBy("blob").agg(F.count("*").alias("n")), "counts")
    return written(hot_keys(counts, "blob", counts.agg(F.sum("n")).first()[0] or 0), "hot")


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows to append to a ledger (columns of LEDGER; a blob may have several; None: nothing has been scanned) after scanning docs."""
    blobs = content(docs).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        unseen = blobs.withColumn("unseen", every)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        unseen = blobs.join(seen, "blob", "left").withColumn("unseen", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("unseen") > 0)
    return written(scan_blobs(unseen, rules), "ledger")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new): doc_id, blob, spans of every row of docs, and the rows to append to the ledger."""
    new = update(docs, ledger, rules)
    known = new if ledger is None else ledger.unionByName(new)
    kinds = [r.kind for r in rules]
    order = F.array(*map(F.lit, kinds))
    hits = known.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("span"), "rules").where(F.col("span.kind").isin(kinds))
    # findings of a rule's older version do not count
    current = F.exists("rules", lambda k: (F.substring_index(k, "@", 1) == F.col("span.kind")) & k.isin([r.key for r in rules]))
    one = F.struct(F.col("span.start").alias("start"), F.array_position(order, F.col("span.kind")).alias("rank"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"))
    hits = written(hits.where(current).groupBy("blob").agg(F.array_sort(F.collect_set(one)).alias("spans")), "hits")
    paths = written(docs.select("doc_id", F.sha2(text_of("text"), 256).alias("blob")), "paths")
    found = spread_join(paths, hits, "blob", hot_blobs(paths))
    empty = F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int>>")
    return found.select("doc_id", "blob", F.coalesce("spans", empty).alias("spans")), new


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """A text with its spans (sorted by where they start, in bytes) replaced; overlapping ones by one mask."""
    none = F.lit(0)
    until = lambda x: running(F.transform(x, lambda s: s["to"]), none, F.greatest)

    def pieces(held: Column) -> Column:
        spans_, ends, data = held["spans"], held["ends"], held["data"]
        before = F.transform(spans_, lambda s, i: F.struct(F.when(i > 0, F.coalesce(F.get(ends, i - 1), none)).otherwise(none).alias("from"), s["from"].alias("to")))
        gaps = F.concat(F.filter(before, lambda g: g["to"] >= g["from"]), F.array(F.struct(F.array_max(ends).alias("from"), F.length(data).alias("to"))))
        return F.array_join(F.transform(gaps, lambda g: F.substring(data, g["from"] + 1, g["to"] - g["from"]).cast("string")), mask)

    return _let(F.struct(spans.alias("spans"), until(spans).alias("ends"), text.cast("binary").alias("data")), pieces)


def redact(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = MASKED) -> DataFrame:
    """docs with every found span's text replaced by mask (overlapping spans by one) and n_chars, if there, set anew.

    The findings are joined to the rows by content, so rows with null or repeated ids are treated alike."""
    new = update(docs, None, rules)
    masks = F.array_sort(F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))))
    hits = written(new.where(F.size("spans") > 0).select("blob", masks.alias("masks")), "hits")
    blob = F.sha2(text_of("text"), 256)
    joined = spread_join(beside(docs, blob=blob, text=text_of("text")), hits, "blob", hot_blobs(docs.select(blob.alias("blob"))))
    clean = joined.withColumn("text", F.when(F.col("masks").isNotNull(), _masked(F.col("text"), F.col("masks"), mask)))
    put = F.when(F.col("text").isNull(), F.col("row"))
    new_row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new_row = new_row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole(clean.select(put.otherwise(new_row).alias("row")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[n(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    def spans(r: Rule, rank: int) -> str:
        p = r.pattern.replace("'", "''")
        held = f"regexp_extract_all(text, '{p}', {r.group})[i]" if r.group else "m[i]"
        return f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM (
            SELECT doc_id, m, i, text, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (
                SELECT doc_id, text, m, string_split_regex(text, '{p}') AS p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m FROM docs) WHERE len(m) > 0))
            WHERE length({held}) >= {r.least}"""

    count = ", ".join(f"count(f.kind) FILTER (f.kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    one = "f.kind || ':' || f.start || ':' || f.stop"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({" UNION ALL ".join(spans(r, i) for i, r in enumerate(RULES))})
SELECT d.doc_id, {count}, sha256(coalesce(string_agg({one}, ',' ORDER BY f.start, f.rank) FILTER (f.kind IN ({kinds})), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY f.start, f.rank), '') AS spans FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"""


OP4_SQL = _sql()

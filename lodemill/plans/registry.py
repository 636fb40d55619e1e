"""All queries over the driver's tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.functions import packages, scalars, sequences, texts
from lodemill.operators import audit, closure, compare, coverage, evaluate, fill, invariants, merge, overlap, rank, scan, validate
from lodemill.plans.base import ORACLES, QUERIES, query, table
from lodemill.shared import spread
from lodemill.sources import recipes, seeds

def orders_as_records(spark: SparkSession, sf_dir: str, snapshot: str = "true") -> DataFrame:
    """Orders (all, or those of a snapshot's condition) in the roles of package records: name, ecosystem, version, ord."""
    o = table(spark, sf_dir, "orders").where(snapshot)
    return o.select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("ecosystem"), F.col("o_orderstatus").alias("version"), F.col("o_orderkey").alias("ord"))


RECORDS_SQL = "SELECT o_custkey AS name, o_orderpriority AS ecosystem, o_orderstatus AS version FROM orders"
CLASSED_SQL = f"""
WITH rec AS ({RECORDS_SQL}),
n AS (SELECT name, bool_or(ecosystem = '1-URGENT') AS has_a, bool_or(ecosystem = '5-LOW') AS has_b,
             bool_or(ecosystem NOT IN ('1-URGENT', '5-LOW')) AS has_other, count(DISTINCT nullif(version, '')) AS n_versions FROM rec GROUP BY name),
c AS (SELECT name, n_versions, has_a AND has_b AND n_versions > 1 AS version_skew,
             CASE WHEN has_a AND has_b THEN 'overlap' WHEN has_a AND NOT has_other THEN 'only_a' WHEN has_b AND NOT has_other THEN 'only_b' ELSE 'other' END AS bucket FROM n)
"""


@query("overlap_summary", CLASSED_SQL + """
SELECT count(*) AS packages_total, count(*) FILTER (bucket = 'overlap') AS overlap, count(*) FILTER (bucket = 'only_a') AS only_a,
       count(*) FILTER (bucket = 'only_b') AS only_b, count(*) FILTER (version_skew) AS version_skew, count(*) FILTER (bucket = 'other') AS other FROM c""")
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.summary(overlap.classify(orders_as_records(spark, sf_dir), "1-URGENT", "5-LOW"))


@query("overlap_detail", CLASSED_SQL + "SELECT * FROM c")
def overlap_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.classify(orders_as_records(spark, sf_dir), "1-URGENT", "5-LOW")


@query("candidate_rank", """
WITH l AS (SELECT l_orderkey, count(*) AS deps, count(*) FILTER (l_returnflag = 'R') AS patches FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey AS name, o_orderpriority AS ecosystem, o_orderstatus AS version, o_orderstatus = 'F' AS tests, coalesce(patches, 0) AS patches,
  (50 + o_orderkey % 50) + 30 * (o_orderstatus = 'F')::INT + 2 * greatest(0, 20 - coalesce(deps, 0)) - 4 * coalesce(patches, 0) AS score FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT name, count(*) AS n_records, sum(score)::BIGINT AS total_score, (sum(score)::DOUBLE / count(*) + CASE WHEN bool_or(ecosystem = '1-URGENT') AND bool_or(ecosystem = '5-LOW') THEN 50 ELSE 0 END)::DECIMAL(18,6)::VARCHAR AS score, bool_or(ecosystem = '1-URGENT') AND bool_or(ecosystem = '5-LOW') AS dual, bool_or(tests) AS has_any_tests,
  sum(patches)::BIGINT AS total_patch_count, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS ecosystems, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM r GROUP BY name""")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores doubled and confidence in percent, so that all sums are whole numbers."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("deps"), F.count_if(F.col("l_returnflag") == "R").alias("n_patches"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["deps", "n_patches"])
    percent, tests = 50 + F.col("o_orderkey") % 50, F.col("o_orderstatus") == "F"
    doubled = 2 * rank.record_score(F.lit(0), tests, F.col("deps"), F.col("n_patches")) + percent
    records = o.select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("ecosystem"), F.col("o_orderstatus").alias("version"), doubled.alias("score"), percent.alias("confidence"), tests.alias("has_tests"), "n_patches")
    found = rank.candidates(records, "1-URGENT", "5-LOW", bonus=50)
    return found.select("name", "n_records", "total_score", F.col("score").cast("decimal(18,6)").cast("string").alias("score"), "dual", "has_any_tests", "total_patch_count", "ecosystems", "versions")


@query("fanin_rank", """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, min(l_linestatus) OVER (PARTITION BY l_orderkey) AS eco FROM lineitem), b AS (SELECT l_partkey AS dep, eco, count(*) AS refs FROM e GROUP BY ALL)
SELECT dep, sum(refs)::BIGINT AS ref_count, string_agg(eco, ',' ORDER BY eco) AS ecosystems, string_agg(eco || '=' || refs, ',' ORDER BY eco || '=' || refs) AS refs_by_ecosystem,
  dep IN (SELECT p_partkey FROM part WHERE p_size > 25) AS in_snapshot FROM b GROUP BY dep HAVING sum(refs) >= 3""")
def fanin_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a record, its ecosystem the least of its line states; its parts are its dependencies."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("dep"), "l_linestatus")
    # one sort a task serves the window and, having the order of its keys, what drops an order's equal parts
    order = Window.partitionBy("record").orderBy("dep").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = spread(lines, "record").select("record", F.min("l_linestatus").over(order).alias("ecosystem"), "dep")
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("name"))
    return rank.fan_in(edges, known, 3)


HALVES_SQL = """
WITH r AS (SELECT o_custkey AS name, o_orderpriority AS eco, max_by(o_orderstatus, o_orderkey) AS v, o_orderdate < TIMESTAMP '1995-10-01' AS old FROM orders GROUP BY ALL),
s AS (SELECT name, old, string_agg(eco, ',' ORDER BY eco) AS ecos FROM r GROUP BY ALL),
m AS (SELECT a.name, bool_or(a.v IS DISTINCT FROM b.v) AS moved FROM r a JOIN r b ON a.name = b.name AND a.eco = b.eco AND a.old AND NOT b.old GROUP BY 1),
d AS (SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN m.moved THEN 'version_changed' WHEN a.ecos <> b.ecos THEN 'ecosystem_changed' ELSE 'unchanged' END AS change
  FROM (SELECT * FROM s WHERE old) a FULL JOIN (SELECT * FROM s WHERE NOT old) b ON a.name = b.name LEFT JOIN m ON m.name = a.name)
"""


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots that hold every order between them: those before a date and those from it on."""
    date = "TIMESTAMP '1995-10-01'"
    return compare.snapshot_diff(orders_as_records(spark, sf_dir, f"o_orderdate < {date}"), orders_as_records(spark, sf_dir, f"o_orderdate >= {date}"))


@query("snapshot_diff", HALVES_SQL + "SELECT * FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)


@query("snapshot_counts", HALVES_SQL + "SELECT " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in ("added", "removed", "version_changed", "ecosystem_changed", "unchanged")) + " FROM d")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.change_counts(_halves(spark, sf_dir))


@query("baseline_diff", """
WITH h AS (SELECT user_id, event_type, day(ts) <= 15 AS old, max(value) >= 50 AS passed FROM events GROUP BY ALL)
SELECT * FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.passed AND NOT b.passed THEN 'regression'
  WHEN NOT a.passed AND b.passed THEN 'fix' END AS change FROM (SELECT * FROM h WHERE old) a FULL JOIN (SELECT * FROM h WHERE NOT old) b ON a.user_id = b.user_id AND a.event_type = b.event_type) WHERE change IS NOT NULL""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = lambda old: e.where((F.dayofmonth("ts") <= 15) == old).groupBy("user_id", "event_type").agg((F.max("value") >= 50).alias("passed"))
    return compare.baseline_diff(half(True), half(False), ["user_id", "event_type"])


@query("compare_sets", """
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'only_a' WHEN a.p_partkey IS NULL THEN 'only_b' WHEN a.v <> b.v THEN 'mismatch' ELSE 'both' END AS side
FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_size <= 30) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS v FROM part WHERE p_size >= 20) b ON a.p_partkey = b.p_partkey""")
def compare_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.where("p_size >= 20").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("v"))
    return compare.compare_sets(p.where("p_size <= 30").select("p_partkey", F.col("p_brand").alias("v")), b, "p_partkey", "v")


@query("multiset_difference", """
SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END)::BIGINT AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) > 0""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return compare.multiset(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "difference")


@query("merge_best", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.best_of(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("dep_union", """
SELECT l_orderkey, l_returnflag, string_agg(p::VARCHAR, ',' ORDER BY p) AS values, count(*) AS n_values FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey AS p FROM lineitem) GROUP BY ALL""")
def dep_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union_of(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_partkey")


@query("version_agreement", """
SELECT name, count(DISTINCT v) AS n_values, count(DISTINCT v) <= 1 AS agree FROM (SELECT o_custkey AS name, o_orderpriority, max_by(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY ALL) GROUP BY name""")
def version_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.agreement(orders_as_records(spark, sf_dir), "name", "ecosystem", "version", "ord")


@query("coverage", "SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS covered FROM documents")
def spec_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.covered(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("coverage_gap", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.orphans(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("vector_coverage", """
SELECT coalesce(spec::VARCHAR, 'all') AS spec, coalesce(category, 'all') AS category, total, n_described, level, (n_described * 2000 + total) // (2 * total) AS tenths FROM (
  SELECT user_id AS spec, event_type AS category, count(*) AS total, count(*) FILTER (value >= 100) AS n_described, GROUPING(user_id, event_type)::BIGINT AS level FROM events GROUP BY ROLLUP (user_id, event_type))""")
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.vector_coverage(table(spark, sf_dir, "events"), F.col("value") >= 100, "user_id", "event_type")
    return found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("spec", "category")})


@query("spec_search", "SELECT doc_id, source FROM documents WHERE (contains(lower(text), 'apache license') OR contains(lower(source), 'apache license')) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def spec_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.search(table(spark, sf_dir, "documents"), "Apache License", ["text", "source"], verified=table(spark, sf_dir, "labels").where("quality = 1"), key="doc_id").select("doc_id", "source")


RESULTS_SQL = "SELECT user_id AS spec, event_type <> 'error' AS passed, event_type = 'signup' AS skipped FROM events"
SUMMARY_SQL = f"SELECT spec, count(*) AS total, count(*) FILTER (passed AND NOT skipped) AS passed, count(*) FILTER (NOT passed AND NOT skipped) AS failed, count(*) FILTER (skipped) AS skipped FROM ({RESULTS_SQL}) GROUP BY spec"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("spec"), (F.col("event_type") != "error").alias("passed"), (F.col("event_type") == "signup").alias("skipped"))


@query("verify_summary", SUMMARY_SQL)
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verify_summary(_results(spark, sf_dir))


@query("verify_totals", f"""SELECT count(*) AS specs, count(*) FILTER (failed = 0 AND passed > 0) AS specs_ok, count(*) FILTER (failed > 0) AS specs_failed, count(*) FILTER (skipped = total) AS specs_skipped,
  sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped FROM ({SUMMARY_SQL})""")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verify_totals(audit.verify_summary(_results(spark, sf_dir)))


@query("status_counts", """
SELECT s.status, s.rank, count(o.o_orderkey) AS n FROM (VALUES ('F', 0), ('O', 1), ('failed', 2)) s(status, rank)
LEFT JOIN orders o ON CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'failed' END = s.status GROUP BY ALL""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(table(spark, sf_dir, "orders"), ["F", "O", "failed"], "failed", "o_orderstatus")


@query("audit_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, ((count(*) FILTER (o_orderstatus = 'F')) * 20000 + count(*)) // (2 * count(*)) AS rate_e4 FROM orders")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "orders"), "F", "o_orderstatus")


@query("wave_status", """
WITH u AS (SELECT user_id AS spec, count(*) AS n, bool_or(event_type = 'purchase') AS done, count(*) FILTER (value >= 50) AS n_pass, count(*) FILTER (value < 50) AS n_fail FROM events GROUP BY 1)
SELECT wave, count(*) AS total, count(*) FILTER (done) AS done, sum(n_pass)::BIGINT AS n_pass, sum(n_fail)::BIGINT AS n_fail, CASE WHEN count(*) FILTER (done) = 0 THEN 'pending' WHEN count(*) FILTER (done) < count(*) THEN 'partial' ELSE 'complete' END AS status
FROM u JOIN (VALUES ('w1', 0, 60), ('w2', 60, 70), ('w3', 65, 100000)) w(wave, low, high) ON u.n >= low AND u.n < high GROUP BY wave""")
def wave_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("spec")).agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("value") >= 50).alias("n_pass"), F.count_if(F.col("value") < 50).alias("n_fail"))
    waves = spark.createDataFrame([("w1", 0, 60), ("w2", 60, 70), ("w3", 65, 100000)], "wave string, low long, high long")
    matched = audit.in_waves(users.select("spec", "n"), waves, (F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")))
    return audit.wave_status(matched, users.select("spec", "done", "n_pass", "n_fail"))


@query("last_attempt", """
SELECT o_custkey, n_attempts, CASE WHEN k % 2 = 0 AND k % 3 > 0 THEN 'success' WHEN k % 3 > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT o_custkey, count(*) AS n_attempts, max(o_orderkey) AS k FROM orders GROUP BY 1)""")
def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return audit.last_attempt(table(spark, sf_dir, "orders").select("o_custkey", k, (k % 3).alias("n_pass"), (k % 2).alias("n_fail")), "o_custkey", "o_orderkey")


@query("pending_specs", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE s IS NULL OR s IN ('P', 'O')")
def pending_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return audit.pending(table(spark, sf_dir, "customer").select("c_custkey"), state, "c_custkey", ("P", "O"))


@query("dup_ids", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("numbered_copies", "SELECT p_partkey, CASE WHEN rn = 0 THEN p_name ELSE p_name || '_' || rn END AS file_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS rn FROM part)")
def numbered_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.numbered_copies(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "file_name")


@query("validate_issues", """
SELECT c_custkey, 'c_acctbal' AS field, 'ERROR' AS level, 'must not be negative' AS message FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT c_custkey, 'c_mktsegment', 'WARN', 'unknown segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL
SELECT c_custkey, 'c_name', 'ERROR', 'required field is missing' FROM customer WHERE coalesce(c_name, '') = ''""")
def validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [validate.Rule("c_acctbal", "ERROR", "must not be negative", F.col("c_acctbal") < 0), validate.Rule("c_mktsegment", "WARN", "unknown segment", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), validate.Rule("c_name", "ERROR", "required field is missing", F.coalesce("c_name", F.lit("")) == "")]
    return validate.issues(table(spark, sf_dir, "customer"), ["c_custkey"], rules)


TURNS_SQL = "SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations"


@query("closure_reach", f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({TURNS_SQL})), r AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT root, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 10)
SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL""")
def closure_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("conv_id") * 1000 + F.col("turn")
    edges = table(spark, sf_dir, "conversations").select(at.alias("src"), (at + 1).alias("dst"))
    return closure.reach(edges, edges.select(F.col("src").alias("root")))


@query("closure_taint", f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({TURNS_SQL})), r AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT root, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 10 AND node % 7 <> 3)
SELECT root, bool_or(node % 7 = 3) AS is_tainted, coalesce(min(depth) FILTER (node % 7 = 3), 0) AS steps, count(DISTINCT node) AS n_reached FROM r GROUP BY root""")
def closure_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("conv_id") * 1000 + F.col("turn")
    edges = table(spark, sf_dir, "conversations").select(at.alias("src"), (at + 1).alias("dst"))
    bad = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).where("node % 7 = 3").distinct()
    return closure.tainted(edges, edges.select(F.col("src").alias("root")), bad, counted=True).withColumn("steps", F.coalesce("steps", F.lit(0)))


#: Turns lead to the next one; in one conversation of three the last leads back to the first, in another turn 3 to turn 1 and turn 5 to turn 2, and every fifth first turn to itself.
CIRCLES_SQL = """SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations WHERE turn < 900
  UNION SELECT max(conv_id * 1000 + turn), min(conv_id * 1000 + turn) FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id
  UNION SELECT conv_id * 1000 + turn, conv_id * 1000 + (CASE turn WHEN 3 THEN 1 ELSE 2 END) FROM conversations WHERE conv_id % 3 = 1 AND turn IN (3, 5)
  UNION SELECT conv_id * 1000 + turn, conv_id * 1000 + turn FROM conversations WHERE conv_id % 5 = 0 AND turn = 0"""


@query("dependency_cycles", f"""
WITH RECURSIVE e AS ({CIRCLES_SQL}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON src = b),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
f AS (SELECT src AS node, min(dst) AS nxt FROM e JOIN c s ON s.node = src JOIN c d ON d.node = dst WHERE s.component = d.component GROUP BY src),
w AS (SELECT node AS start, nxt AS onto, 1 AS n FROM f UNION SELECT start, nxt, n + 1 FROM w JOIN f ON f.node = onto WHERE onto <> start AND n < 1000),
o AS (SELECT DISTINCT w.start FROM w WHERE onto = start), k AS (SELECT start, min(onto) AS least FROM w JOIN o USING (start) GROUP BY start),
m AS (SELECT component, min(least) AS first FROM k JOIN c ON c.node = k.start GROUP BY component),
p AS (SELECT first AS node, first, 0 AS place FROM m UNION SELECT nxt, first, place + 1 FROM p JOIN f USING (node) WHERE nxt <> first)
SELECT c.node, c.component, coalesce(p.place, -1)::BIGINT AS place FROM c LEFT JOIN p USING (node)""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 1000 + F.col("turn")
    onward = turns.where("turn < 900").select(at.alias("src"), (at + 1).alias("dst"))
    around = turns.where("conv_id % 3 = 0").groupBy("conv_id").agg(F.max(at).alias("src"), F.min(at).alias("dst")).select("src", "dst")
    inner = turns.where("conv_id % 3 = 1 AND turn IN (3, 5)").select(at.alias("src"), (F.col("conv_id") * 1000 + F.when(F.col("turn") == 3, 1).otherwise(2)).alias("dst"))
    loops = turns.where("conv_id % 5 = 0 AND turn = 0").select(at.alias("src"), at.alias("dst"))
    return closure.cycles(onward.union(around).union(inner).union(loops)).withColumn("place", F.coalesce("place", F.lit(-1).cast("long")))


@query("dependency_layers", "SELECT p_partkey AS node, p_partkey - (SELECT min(p_partkey) FROM part) AS layer FROM part")
def dependency_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part needs the one before it, and one in a thousand also the one of half its key: one chain as long as the table."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    needs = p.select("src", F.explode(F.array(F.col("src") - 1, F.when(F.col("src") % 1000 == 500, F.floor(F.col("src") / 2)))).alias("dst"))
    return closure.layers(needs.join(p.select(F.col("src").alias("dst")), "dst", "left_semi"))


@query("license_class", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'permissive' WHEN 1 THEN 'copyleft' WHEN 2 THEN 'permissive' WHEN 3 THEN 'copyleft' ELSE 'unknown' END AS class FROM part""")
def license_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("MIT", "LGPL-2.1", "GPL-3.0 OR Apache-2.0", "MIT AND GPL-2.0", "Custom AND MIT", "Proprietary")))
    verdict = packages.permissive(F.get(names, (F.col("p_partkey") % 6).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(verdict, "permissive").when(~verdict, "copyleft").otherwise("unknown").alias("class"))


@query("version_range", "SELECT p_partkey, (p_size, p_partkey % 10) >= (10, 5) AND (p_size, p_partkey % 10) < (30, 0) AS fits FROM part")
def version_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", packages.satisfies(version, ">=10.5, <30").alias("fits"))


@query("version_ranges", """
WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 10 AS b, p_size % 20 + 1 AS x, p_partkey % 7 AS y FROM part)
SELECT p_partkey, coalesce(fits, FALSE) AS fits, readable FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN (a, b) >= (x, y) AND (a, b) < (x + 15, 0) WHEN 1 THEN a = x AND b >= y WHEN 2 THEN a = x WHEN 3 THEN (a, b) <> (x, y) WHEN 4 THEN (a, b) <= (x, y) OR b = 9
    WHEN 5 THEN TRUE WHEN 6 THEN (a, b) > (x, y) AND a <> x + 1 ELSE NULL END AS fits, p_partkey % 8 <> 7 AS readable FROM v)""")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part has a version and a range of its own; one in eight ranges is free, one can't be read."""
    size, key = F.col("p_size"), F.col("p_partkey")
    x, y = (size % 20 + 1).cast("string"), (key % 7).cast("string")
    own = F.concat_ws(".", size.cast("string"), (key % 10).cast("string"))
    # one in ten of the fourth kind is a version that can't be read, which any range holds
    version = F.when((key % 8 == 4) & (key % 10 == 9), "unknown").otherwise(own)
    to = F.concat(x, F.lit("."), y)
    kinds = [F.concat(F.lit(">="), to, F.lit(", <"), (size % 20 + 16).cast("string")), F.concat(F.lit("~="), to), F.concat(F.lit("=="), x, F.lit(".*")), F.concat(F.lit("!="), to), F.concat(F.lit("<="), to), F.lit("N/A"), F.concat(F.lit(">"), to, F.lit(" !="), (size % 20 + 2).cast("string"), F.lit(".*"))]
    constraint = F.coalesce(F.get(F.array(*kinds), (key % 8).cast("int")), F.lit("about 3"))
    found = spread(table(spark, sf_dir, "part")).select("p_partkey", packages.satisfies(version, constraint).alias("found"))
    return found.select("p_partkey", F.coalesce("found", F.lit(False)).alias("fits"), F.col("found").isNotNull().alias("readable"))


@query("skip_by_row", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size >= p_partkey % 40 AND p_partkey % 5 <> 1 WHEN 1 THEN NOT (p_size < p_partkey % 40) OR p_partkey % 5 = 0 ELSE p_brand = 'Brand#' || (p_partkey % 60) END AS skipped FROM part""")
def skip_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part has a condition of its own."""
    key, bound = F.col("p_partkey"), (F.col("p_partkey") % 40).cast("string")
    fits = lambda op: F.concat(F.lit(f'semver_satisfies(lib_version, "{op}'), bound, F.lit('")'))
    two = (key % 5).cast("string")
    texts = [F.concat(fits(">="), F.lit(' and "'), two, F.lit('" != "1"')), F.concat(F.lit("not "), fits("<"), F.lit(" or '0' == '"), two, F.lit("'")), F.concat(F.lit("platform == 'Brand#"), (key % 60).cast("string"), F.lit("'"))]
    skip_if = F.get(F.array(*texts), (key % 3).cast("int"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", invariants.skipped(skip_if, F.col("p_size").cast("string"), F.col("p_brand")).alias("skipped"))


@query("invariant_expand", """
SELECT r_name AS spec, n_nationkey % 2 = 0 AS even, r_name || '.n.' || n_nationkey AS id, 'nation ' || n_name || ' of {' || n_nationkey || '}' AS description,
  CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'general' END AS category, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'own' ELSE 'all' END AS scope
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def invariant_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as tables of cases, nations as their rows."""
    key = F.col("n_nationkey").cast("string")
    cells = F.array(key, "n_name", F.when(F.col("n_nationkey") % 2 == 0, "even"))
    own = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("scope"), F.lit("own")))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(cells.alias("cells"), own.alias("overrides"))).alias("rows"))
    text = lambda v: F.lit(v).cast("string")
    tables = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("spec"), text("nations").alias("label"), text("call_eq").alias("kind"), text(None).alias("category"), text("n").alias("id_prefix"), text(None).alias("id_from"),
        text("nation {name} of {{{id}}}").alias("describe"), text(None).alias("rfc"), text(None).alias("skip_if"),
        F.create_map(text("scope"), text("all")).alias("shared"), F.array(*map(F.lit, ["id", "name", "category"])).alias("columns"), "rows",
    )
    made = invariants.expand(tables)
    return made.select("spec", (F.col("category") == "even").alias("even"), "id", "description", "category", F.col("fields")["name"].alias("name"), F.col("fields")["scope"].alias("scope"))


@query("skip_conditions", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size >= 30 WHEN 1 THEN p_partkey % 3 = 0 WHEN 2 THEN p_size < 10 AND p_partkey % 3 <> 0 ELSE FALSE END AS skipped FROM part""")
def skip_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ['semver_satisfies(lib_version, ">=30")', 'platform == "darwin"', 'semver_satisfies(lib_version, "<10") and not platform == "darwin"', "no such(thing"]
    key, version = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(".0"))
    skip_if = F.get(F.array(*map(F.lit, texts)), (key % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", invariants.skipped(skip_if, version, F.when(key % 3 == 0, "darwin").otherwise("linux")).alias("skipped"))


@query("python_seeds", """
SELECT DISTINCT replace(lower(p_brand), '#', '-') || '-' || p_size AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 7 <> 0""")
def python_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ports: two in three are named py-*, half come from the index, one in seven has an unexpanded name."""
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, "${NAME}").otherwise(F.concat_ws("_", F.translate("p_brand", "#", "-"), F.col("p_size").cast("string")))
    path = F.concat(F.when(key % 3 == 0, "devel/").when(key % 3 == 1, "devel/py-").otherwise("py-"), name)
    source = F.struct(F.when(key % 2 == 0, "pypi").otherwise("https://example.org").alias("url"))
    return seeds.python_names(table(spark, sf_dir, "part").select(F.struct(name.alias("canonical_name"), path.alias("ecosystem_id")).alias("identity"), F.array(source).alias("sources")))


@query("url_normalize", r"""
SELECT page_id, regexp_extract(url, '^[^/]*//') || lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)) || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1)
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')) AS q FROM pages)""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.without_tracking(F.col("url")).alias("url"))


@query("url_paths", r"""
SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, regexp_extract(p, '([^/]*)$', 1) AS basename, CASE WHEN regexp_extract(p, '^(.*)/', 1) = '' AND p LIKE '/%' THEN '/' ELSE regexp_extract(p, '^(.*)/', 1) END AS dirname,
  regexp_extract(regexp_extract(p, '([^/]*)$', 1), '(\.[^.]*)$', 1) AS extension FROM (SELECT page_id, url, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "//[^/?#]*([^?#]*)", 1).alias("p"))
    return p.select("page_id", scalars.url_host(F.col("url")).alias("host"), scalars.basename(F.col("p")).alias("basename"), scalars.dirname(F.col("p")).alias("dirname"), scalars.extension(F.col("p")).alias("extension"))


@query("json_props", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("consecutive_runs", """
WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m) SELECT user_id, run, event_type, count(*) AS n FROM p GROUP BY ALL""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("pairwise", "SELECT event_id, event_type, next_value FROM (SELECT *, lead(event_type) OVER w AS next_value, lead(1) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE m = 1")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.pairs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "next_value")


@query("batched", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS batch FROM events")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.batches(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "batch")


@query("accumulate", """
SELECT o_orderkey, sum(o_orderkey) OVER w::BIGINT AS running_sum, max(o_orderkey) OVER w AS running_max, min(o_orderkey) OVER w AS running_min FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.accumulated(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "running_sum", "running_max", "running_min")


@query("most_common", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.most_common(table(spark, sf_dir, "part"), "p_name", 10)


@query("accumulate_whole", """
SELECT o_orderkey, sum(o_orderkey) OVER w::BIGINT AS running_sum, max(o_custkey) OVER w AS running_max, row_number() OVER w AS at FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def accumulate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for all rows: blocks of the sorted table and their sums, in as many tasks."""
    folds = {"running_sum": ("sum", F.col("o_orderkey")), "running_max": ("max", F.col("o_custkey"))}
    return scan.scanned(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), [], ["o_orderdate", "o_orderkey"], at="at", **folds).select("o_orderkey", *folds, "at")


@query("runs_whole", """
WITH m AS (SELECT event_type, row_number() OVER w AS i, event_type IS DISTINCT FROM lag(event_type) OVER w AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
r AS (SELECT event_type, sum(new::INT) OVER (ORDER BY i) - 1 AS run FROM m) SELECT run::BIGINT AS run, event_type, count(*) AS n FROM r GROUP BY ALL""")
def runs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal events over the whole stream as one sequence."""
    return sequences.runs(table(spark, sf_dir, "events"), [], ["ts", "event_id"], "event_type").select("run", "event_type", "n")


@query("exact_median", """
WITH c AS (SELECT l_extendedprice AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT median(l_extendedprice) FROM lineitem) AS median, (SELECT x FROM c ORDER BY n DESC, x LIMIT 1) AS mode""")
def exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices as one group: the middle is found by a scan over counted values in order, no task holds the group."""
    return sequences.spread_statistics(table(spark, sf_dir, "lineitem"), [], "l_extendedprice").select("median", "mode")


@query("spread_median", """
SELECT l_suppkey, median(l_quantity)::DOUBLE AS median, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1""")
def spread_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    span = lines.groupBy("l_suppkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("span"))
    return sequences.spread_statistics(lines, ["l_suppkey"], "l_quantity").select("l_suppkey", "median").join(span, "l_suppkey")


@query("stats_quantity", """
SELECT l_returnflag, round(avg(l_quantity)::DECIMAL(18,6), 3)::VARCHAR AS mean, round(median(l_quantity)::DECIMAL(18,6), 3)::VARCHAR AS median, round(stddev_samp(l_quantity)::DECIMAL(18,6), 3)::VARCHAR AS stdev FROM lineitem GROUP BY 1""")
def stats_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*sequences.statistics("l_quantity"))
    return found.select("l_returnflag", *[F.round(F.col(c).cast("decimal(18,6)"), 3).cast("string").alias(c) for c in ("mean", "median", "stdev")])


@query("first_mode", """
SELECT o_custkey, s AS mode FROM (SELECT o_custkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def first_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_custkey", "mode")


@query("bucketize", "SELECT p_partkey, (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 35)::INT AS bucket FROM part")
def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sequences.bucket(F.col("p_size"), [10, 20, 35]).alias("bucket"))


@query("encodings", "SELECT c_custkey, sha256(c_name) AS sha256, md5(c_name) AS md5, hex(c_name::BLOB) AS hex, translate(base64(c_name::BLOB), '+/', '-_') AS base64 FROM customer")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(n, 256).alias("sha256"), F.md5(n).alias("md5"), F.hex(n).alias("hex"), scalars.urlsafe_base64(n).alias("base64"))


@query("calendar", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS weekday, day(last_day(o_orderdate))::INT AS month_days, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap FROM orders")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.weekday(d).alias("weekday"), F.dayofmonth(F.last_day(d)).alias("month_days"), scalars.is_leap(F.year(d)).alias("leap"))


@query("gcd_comb", "SELECT p_partkey, gcd(p_partkey, p_size)::BIGINT AS g FROM part")
def gcd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.gcd(F.col("p_partkey"), F.col("p_size")).alias("g"))


@query("private_addresses", "SELECT c_custkey, c_custkey % 3 = 0 AS private FROM customer")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of keys: every third in 172.16.0.0/12, the others outside all private networks."""
    k = F.col("c_custkey")
    address = F.concat_ws(".", F.lit("172"), F.when(k % 3 == 0, 16 + k % 16).otherwise(32 + k % 64).cast("string"), (k % 256).cast("string"), (k % 251).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.is_private_ipv4(address).alias("private"))


@query("glob_names", "SELECT p_partkey, regexp_matches(p_name, '^[a-m].*e.$') AS hit FROM part")
def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.matches_glob(F.col("p_name"), "[a-m]*e?").alias("hit"))


@query("constants_hold", """
SELECT c_custkey AS id, n_name IS NOT NULL AS passed, CASE WHEN n_name IS NOT NULL THEN 'equal' WHEN known THEN 'another value' ELSE 'unknown constant' END AS message
FROM (SELECT c_custkey, c_custkey % 30 AS wanted, c_custkey % 25 AS value, c_custkey % 30 < 25 AS known FROM customer) LEFT JOIN nation ON n_nationkey = wanted AND n_nationkey = value""")
def constants_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' keys as constants; customers expect values of them, some of constants that do not exist."""
    constants = table(spark, sf_dir, "nation").select(F.lit("s").alias("spec"), F.col("n_nationkey").cast("long").alias("name"), F.col("n_nationkey").cast("long").alias("value"))
    wanted = table(spark, sf_dir, "customer").select(F.lit("s").alias("spec"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 30).alias("name"), (F.col("c_custkey") % 25).alias("expected_value"))
    return evaluate.constants_hold(wanted, constants).select("id", "passed", "message")


@query("known_digests", "SELECT p_partkey, p_partkey % 3 <> 2 AS passed FROM part")
def known_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three parts expect the digest of their name, the others that of another text."""
    key, name = F.col("p_partkey"), F.col("p_name").cast("binary")
    algorithm = F.when(key % 2 == 0, "sha256").otherwise("md5")
    other = F.when(key % 3 == 2, F.concat(name, F.lit(b"x"))).otherwise(name)
    wanted = F.when(key % 2 == 0, F.sha2(other, 256)).otherwise(F.md5(other))
    return table(spark, sf_dir, "part").select("p_partkey", evaluate.known_digest(algorithm, name, wanted).alias("passed"))


@query("outputs_hold", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority = '1-URGENT' WHEN 1 THEN contains(o_orderpriority, 'LOW') WHEN 2 THEN regexp_matches(o_orderpriority, '^[1-3]-') ELSE contains(o_orderstatus, 'O') END AS passed FROM orders""")
def outputs_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commands that wrote their priority and, as errors, their status."""
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % 4).cast("int"))
    kind = pick("cli_stdout_eq", "cli_stdout_contains", "cli_stdout_matches", "cli_stderr_contains")
    expected = pick("1-URGENT", "LOW", "^[1-3]-", "O")
    held = evaluate.output_holds(kind, F.lit(0), F.concat("o_orderpriority", F.lit("\n")), F.col("o_orderstatus"), expected)
    return table(spark, sf_dir, "orders").select("o_orderkey", held.alias("passed"))


@query("lcm_numbers", "SELECT p_partkey, lcm(p_partkey, p_size)::BIGINT AS l FROM part")
def lcm_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.lcm(F.col("p_partkey"), F.col("p_size")).alias("l"))


@query("quoted_urls", "SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted, url AS back FROM pages")
def quoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = scalars.quoted(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", quoted.alias("quoted"), scalars.unquoted(quoted).alias("back"))


#: Orders as nested records: a customer is a name, a priority an ecosystem, a status a version, the parts on its lines are dependencies.
NESTED_SQL = """
WITH d AS (SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'build' WHEN 'N' THEN 'host' ELSE 'runtime' END AS bucket, (l_partkey % 40)::VARCHAR AS dep FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS deps FROM d GROUP BY 1),
r AS (SELECT o_custkey AS name, o_orderkey AS ord, o_orderpriority AS eco, o_orderstatus AS version, 50 + o_orderkey % 50 AS pct, 's' || o_orderkey AS summary, o_orderkey % 11 = 0 AS deprecated, coalesce(deps, 0) AS deps,
  'L' || (o_orderkey % 3) AS lic, ['m' || (o_orderkey % 7), 'm' || (o_orderkey % 5)] AS maint, CASE WHEN o_orderkey % 4 = 0 THEN ['c' || (o_orderkey % 13)] ELSE [] END AS confl, ['p' || (o_orderkey % 3)] AS plat, 'u' || (o_orderkey % 17) AS url
  FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
best AS (SELECT name, arg_max(ord, pct * 1000000000000 - ord) AS ord FROM r GROUP BY 1)
"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    bucket = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    # one set of numbers an order, bucket and part in one, is cheaper than a set of texts for each bucket
    codes = lines.groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 40).cast("int") * 3 + bucket).alias("codes"))
    dep = lambda b: F.array_sort(F.transform(F.filter("codes", lambda x: F.pmod(x, F.lit(3)) == b), lambda x: F.floor(x / 3).cast("string")))
    deps = codes.select("l_orderkey", *[dep(i).alias(b) for i, b in enumerate(("build", "host", "runtime"))])
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    held = lambda c: F.coalesce(c, none)
    source = F.struct(F.lit("archive").alias("type"), text("u", 17).alias("url"))
    return table(spark, sf_dir, "orders").join(deps, k == F.col("l_orderkey"), "left").select(
        F.struct(F.col("o_custkey").cast("string").alias("canonical_name"), F.col("o_orderpriority").alias("ecosystem"), F.col("o_orderstatus").alias("version")).alias("identity"),
        F.struct(F.concat(F.lit("s"), k.cast("string")).alias("summary"), F.lit("").alias("homepage"), F.array(text("L", 3)).alias("license"), F.array(text("m", 7), text("m", 5)).alias("maintainers"), (k % 11 == 0).alias("deprecated")).alias("descriptive"),
        F.array(source).alias("sources"), F.struct(held("build").alias("build"), held("host").alias("host"), held("runtime").alias("runtime"), none.alias("test")).alias("dependencies"),
        F.when(k % 4 == 0, F.array(text("c", 13))).otherwise(none).alias("conflicts"), F.struct(F.array(text("p", 3)).alias("include"), none.alias("exclude")).alias("platforms"),
        F.struct(((50 + k % 50) / 100).alias("confidence"), none.alias("warnings")).alias("provenance"), F.lit(False).alias("stub"), F.lit("0.1").alias("schema_version"), k.alias("_ord"),
    )


def _joined(*columns: str) -> list:
    return [F.array_join(c, ",").alias(c) for c in columns]


@query("extraction", NESTED_SQL + """,
e AS (SELECT name, eco, arg_max(version, ord) AS version, arg_max(lic, ord) AS lic, arg_max(pct, ord) AS pct, arg_max(deps, ord) AS deps, bool_or(deprecated) AS deprecated FROM r GROUP BY ALL),
pairs AS (SELECT a.name, string_agg(CASE WHEN b.deps > a.deps THEN b.eco || ' has ' || (b.deps - a.deps) || ' more dep(s) than ' || a.eco ELSE a.eco || ' has ' || (a.deps - b.deps) || ' more dep(s) than ' || b.eco END, '; ' ORDER BY a.eco, b.eco) AS said
  FROM e a JOIN e b ON a.name = b.name AND a.eco < b.eco AND a.deps <> b.deps GROUP BY 1),
per AS (SELECT name, string_agg(eco, ',' ORDER BY eco) AS ecosystems, count(DISTINCT version) <= 1 AS version_agreement, count(DISTINCT lic) <= 1 AS license_agreement, bool_or(deprecated) AS deprecated,
  (20 * sum(pct) + count(*)) // (2 * count(*)) AS confidence_e3, string_agg(eco || '=' || version, ', ' ORDER BY eco) AS skew, max(version) AS one, string_agg(eco, ', ' ORDER BY eco) FILTER (deprecated) AS dep_in FROM e GROUP BY 1),
lists AS (SELECT name, string_agg(DISTINCT lic, ',' ORDER BY lic) AS license, string_agg(DISTINCT plat[1], ',' ORDER BY plat[1]) AS platforms_include, string_agg(DISTINCT url, ',' ORDER BY url) AS sources FROM r GROUP BY 1),
m AS (SELECT name, string_agg(DISTINCT x, ',' ORDER BY x) AS maintainers FROM (SELECT name, unnest(maint) AS x FROM r) GROUP BY 1), c AS (SELECT name, string_agg(DISTINCT x, ',' ORDER BY x) AS conflicts FROM (SELECT name, unnest(confl) AS x FROM r) GROUP BY 1),
b AS (SELECT name, string_agg(DISTINCT dep, ',' ORDER BY dep) FILTER (bucket = 'build') AS build_deps, string_agg(DISTINCT dep, ',' ORDER BY dep) FILTER (bucket = 'runtime') AS runtime_deps FROM r JOIN d ON l_orderkey = ord GROUP BY 1)
SELECT p.name::VARCHAR AS name, ecosystems, 's' || best.ord AS summary, license, maintainers, coalesce(conflicts, '') AS conflicts, platforms_include, sources, coalesce(build_deps, '') AS build_deps, coalesce(runtime_deps, '') AS runtime_deps, deprecated, version_agreement, license_agreement, confidence_e3::BIGINT AS confidence_e3,
  CASE WHEN version_agreement THEN 'version agreement: all ecosystems at ''' || one || '''' ELSE 'version skew: ' || skew END || coalesce('; ' || said, '') || coalesce('; deprecated in: ' || dep_in, '') AS notes
FROM per p JOIN best USING (name) JOIN lists USING (name) LEFT JOIN m USING (name) LEFT JOIN c USING (name) LEFT JOIN b USING (name) LEFT JOIN pairs USING (name)""")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.extracted(_nested(spark, sf_dir))
    lists = ("ecosystems", "license", "maintainers", "conflicts", "platforms_include", "sources", "build_deps", "runtime_deps")
    return found.select("name", "summary", *_joined(*lists), "deprecated", "version_agreement", "license_agreement", (F.col("confidence_avg") * 1000).cast("long").alias("confidence_e3"), F.array_join("notes", "; ").alias("notes"))


@query("bulk_merge", NESTED_SQL + """,
k AS (SELECT r.*, r.ord <> best.ord AS later FROM r JOIN best USING (name)),
m AS (SELECT name, string_agg(x, ',' ORDER BY later, ord, i) AS maintainers FROM (SELECT *, row_number() OVER (PARTITION BY name, x ORDER BY later, ord, i) AS rn FROM (SELECT name, later, ord, unnest(maint) AS x, unnest([1, 2]) AS i FROM k)) WHERE rn = 1 GROUP BY 1),
s AS (SELECT name, string_agg(url, ',' ORDER BY later, ord) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY name, url ORDER BY later, ord) AS rn FROM k) WHERE rn = 1 GROUP BY 1),
h AS (SELECT name, string_agg(dep, ',' ORDER BY later, ord, dep) AS host_deps FROM (SELECT *, row_number() OVER (PARTITION BY name, dep ORDER BY later, ord) AS rn FROM k JOIN d ON l_orderkey = ord WHERE bucket = 'host') WHERE rn = 1 GROUP BY 1)
SELECT name::VARCHAR AS name, best.ord AS base, merged_from, maintainers, sources, coalesce(host_deps, '') AS host_deps FROM best JOIN (SELECT name, string_agg(DISTINCT eco, ',' ORDER BY eco) AS merged_from FROM r GROUP BY 1) USING (name)
JOIN m USING (name) JOIN s USING (name) LEFT JOIN h USING (name)""")
def bulk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.bulk_merged(_nested(spark, sf_dir))
    host = F.array_join("dependencies.host", ",").alias("host_deps")
    return found.select("name", F.col("_ord").alias("base"), *_joined("merged_from"), F.array_join("descriptive.maintainers", ",").alias("maintainers"), F.array_join("sources.url", ",").alias("sources"), host)


@query("stub_merge", NESTED_SQL + """,
m AS (SELECT name, string_agg(x, ',' ORDER BY pct DESC, ord, i) AS maintainers FROM (SELECT *, row_number() OVER (PARTITION BY name, x ORDER BY pct DESC, ord, i) AS rn FROM (SELECT name, pct, ord, unnest(maint) AS x, unnest([1, 2]) AS i FROM r)) WHERE rn = 1 GROUP BY 1),
p AS (SELECT name, string_agg(x, ',' ORDER BY pct DESC, ord) AS platforms FROM (SELECT *, row_number() OVER (PARTITION BY name, x ORDER BY pct DESC, ord) AS rn FROM (SELECT name, pct, ord, unnest(plat) AS x FROM r)) WHERE rn = 1 GROUP BY 1)
SELECT name::VARCHAR AS name, best.ord AS base, maintainers, platforms, TRUE AS stub, 1::BIGINT AS n_warnings FROM best JOIN m USING (name) JOIN p USING (name)""")
def stub_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.stubs(_nested(spark, sf_dir))
    return found.select("name", F.col("_ord").alias("base"), F.array_join("descriptive.maintainers", ",").alias("maintainers"), F.array_join("platforms.include", ",").alias("platforms"), "stub", F.size("provenance.warnings").cast("long").alias("n_warnings"))


@query("record_issues", """
WITH c AS (SELECT c_custkey AS k, c_acctbal, c_mktsegment AS seg, c_nationkey AS n FROM customer)
SELECT k, 'provenance.confidence' AS field, 'ERROR' AS level, 'out of range [0, 1]' AS message FROM c WHERE c_acctbal < 0 OR c_acctbal > 8000 UNION ALL
SELECT k, 'identity.ecosystem', 'WARN', 'unknown value ''' || seg || '''' FROM c WHERE n % 5 <> 0 UNION ALL
SELECT k, 'identity.ecosystem', 'ERROR', 'required and must be non-empty' FROM c WHERE n % 5 = 0 UNION ALL
SELECT k, 'sources[' || i || ']', 'ERROR', 'missing required field ''type''' FROM (SELECT k, unnest(range(n % 4)) AS i, n FROM c) WHERE (i + n) % 2 = 0 UNION ALL
SELECT k, 'conflicts[' || i || ']', 'ERROR', 'must be a string, got ' || CASE WHEN i = 0 THEN 'int' ELSE 'NoneType' END FROM (SELECT k, unnest([0, 2]) AS i FROM c WHERE n % 3 = 1) UNION ALL
SELECT k, 'dependencies.test', 'ERROR', CASE WHEN n % 2 = 0 THEN 'required field missing' ELSE 'must be an array' END FROM c UNION ALL
SELECT k, 'tests', 'ERROR', 'required field missing' FROM c WHERE n % 7 = 0""")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON records with a balance for a confidence, a segment for an ecosystem, and lists with bad elements."""
    n = F.col("c_nationkey")
    texts = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kinds = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n % 4), lambda i: F.when((i + n) % 2 == 0, '{"url": "u"}').otherwise('{"type": "t"}'))
    eco = F.when(n % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    value = texts(
        '{"schema_version": "0.2", "identity": {"canonical_name": "n", "canonical_id": "i", "version": 1, "ecosystem_id": "e", "ecosystem": "', eco, '"}, "descriptive": {"license": [], "deprecated": false}, "sources": [', F.array_join(kinds, ", "),
        '], "dependencies": {"build": ["a"], "host": [], "runtime": []', F.when(n % 2 == 0, "").otherwise(', "test": {}'), '}, "build": {}, "features": {}, "platforms": {}, "conflicts": ', F.when(n % 3 == 1, '[1, "x", null]').otherwise("[]"),
        ', "patches": [], "extensions": null, ', F.when(n % 7 == 0, "").otherwise('"tests": {}, '), '"provenance": {"confidence": ', (F.col("c_acctbal") / 8000).cast("decimal(18,8)").cast("string"), "}}",
    )
    return validate.issue_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.parse_json(value).alias("v")), ["k"], validate.record_issues("v"))


@query("spec_issues", """
WITH f AS (SELECT o_custkey AS k, o_orderkey % 5 AS id, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT k, 'invariants[' || i || ']' AS field, 'ERROR' AS level, 'duplicate id ''' || id || '''' AS message FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY i) AS rn FROM f) WHERE rn > 1 UNION ALL
SELECT k, 'invariants[' || i || ']', 'ERROR', 'unknown kind ''' || st || '''' FROM f WHERE st <> 'F' UNION ALL
SELECT k, 'invariants[' || i || ']', 'ERROR', 'arg_types length (1) does not match args length (' || id || ')' FROM f WHERE id <> 1 UNION ALL
SELECT DISTINCT k, 'wire_formats', 'ERROR', 'missing required field ''wire_formats''' FROM f UNION ALL SELECT DISTINCT k, 'error_model', 'ERROR', 'missing required field ''error_codes''' FROM f""")
def spec_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as compiled specifications, their orders as invariants."""
    number = (F.col("o_orderkey") % 5).cast("string")
    args = F.array_join(F.array_repeat(F.lit("1"), (F.col("o_orderkey") % 5).cast("int")), ", ")
    one = F.concat(F.lit('{"id": "'), number, F.lit('", "category": "c", "description": "d", "kind": "'), F.when(F.col("o_orderstatus") == "F", "call_eq").otherwise(F.col("o_orderstatus")), F.lit('", "spec": {"arg_types": ["c_int"], "args": ['), args, F.lit("]}}"))
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("one")))).alias("all"))
    head = '{"schema_version": "1", "identity": {"canonical_name": "n", "spec_for_versions": ""}, "provenance": {"derived_from": [], "not_derived_from": null}, "library": {"soname_patterns": []}, "constants": {}, "types": {}, "functions": {}, "error_model": {"return_code_semantics": ""}, "invariants": ['
    value = F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["one"]), ", "), F.lit("]}"))
    return validate.issue_rows(per.select("k", F.parse_json(value).alias("v")), ["k"], validate.spec_issues("v"))


@query("coverage_totals", "SELECT count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS gap, (count(l.doc_id) * 2000 + count(*)) // (2 * count(*)) AS tenths FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_totals(spec_coverage(spark, sf_dir))


@query("coverage_by_names", """
WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'old' ELSE 'c-' || (c_custkey % 500) END AS name FROM customer),
s AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'c_' || p_partkey ELSE 'c-' || p_partkey END AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'new_name')
SELECT c_custkey, name, name IN (SELECT name FROM s) OR replace(name, '-', '_') IN (SELECT name FROM s) OR name = 'old' AS covered FROM i""")
def coverage_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers share names; parts are specifications under names with - or _, and one under another name of a customer's."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    text = lambda *parts: F.concat(*parts)
    items = table(spark, sf_dir, "customer").select(k, F.when(k % 9 == 0, "old").otherwise(text(F.lit("c-"), (k % 500).cast("string"))).alias("name"))
    specs = table(spark, sf_dir, "part").where(p % 3 == 0).select(text(F.when(p % 2 == 0, "c_").otherwise("c-"), p.cast("string")).alias("name"))
    return coverage.covered(items, specs.union(spark.createDataFrame([("new_name",)], "name string")), "name", {"old": "new-name"})


@query("low_coverage", "SELECT user_id::VARCHAR AS spec, count(*) AS total, count(*) FILTER (value >= 100) AS n_described FROM events GROUP BY 1 HAVING (count(*) FILTER (value >= 100) * 2000 + count(*)) // (2 * count(*)) < 125")
def low_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.vector_coverage(table(spark, sf_dir, "events"), F.col("value") >= 100, "user_id", "event_type")
    return coverage.below_score(found, 12.5).select(F.col("spec").cast("string").alias("spec"), "total", "n_described")


@query("top_by_score", "SELECT o_orderkey, o_custkey FROM orders ORDER BY CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey % 100 END DESC, lpad(o_orderkey::VARCHAR, 12, '0') LIMIT 50")
def top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 10 != 0, F.col("o_custkey") % 100).alias("score"), F.lpad(k.cast("string"), 12, "0").alias("file"))
    return coverage.by_score(o, 50).select("o_orderkey", "o_custkey")


@query("verify_totals_errors", f"""SELECT count(*) AS specs, count(*) FILTER (failed = 0 AND passed > 0 AND error = '') AS specs_ok, count(*) FILTER ((failed > 0 OR error <> '') AND error NOT LIKE '%LibraryNotFoundError%') AS specs_failed,
  count(*) FILTER (error LIKE '%LibraryNotFoundError%' OR (skipped = total AND error = '')) AS specs_skipped, sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped
  FROM (SELECT *, CASE spec % 5 WHEN 0 THEN 'LibraryNotFoundError: z' WHEN 1 THEN 'boom' ELSE '' END AS error FROM ({SUMMARY_SQL}))""")
def verify_totals_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.verify_summary(_results(spark, sf_dir))
    error = F.when(F.col("spec") % 5 == 0, f"{audit.NO_LIBRARY}: z").when(F.col("spec") % 5 == 1, "boom")
    return audit.verify_totals(found.withColumn("error", error))


@query("names_by_status", """
SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'failed' END AS status, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, string_agg(DISTINCT (o_custkey % 50)::VARCHAR, ',' ORDER BY (o_custkey % 50)::VARCHAR) AS names FROM orders GROUP BY 1, 2""")
def names_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 50).alias("name"))
    return audit.names_by_status(o, ["F", "O", "failed"], "failed", status="o_orderstatus").withColumn("rank", F.col("rank").cast("int"))


@query("audit_sums", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, ((count(*) FILTER (o_orderstatus = 'F')) * 20000 + count(*)) // (2 * count(*)) AS rate_e4, sum(o_orderkey % 7)::BIGINT AS pass_count, sum(o_orderkey % 3)::BIGINT AS fail_count, sum(o_orderkey % 7 + o_orderkey % 3)::BIGINT AS total_invariants FROM orders")
def audit_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return audit.audit(table(spark, sf_dir, "orders").select("o_orderstatus", (k % 7).alias("pass_count"), (k % 3).alias("fail_count"), (k % 7 + k % 3).alias("total_invariants")), "F", "o_orderstatus")


@query("wave_summary", "SELECT count(*) AS specs, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, sum(o_orderkey % 7)::BIGINT AS n_pass, sum(o_orderkey % 3)::BIGINT AS n_fail FROM orders")
def wave_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return audit.wave_summary(table(spark, sf_dir, "orders").select("o_orderstatus", (k % 7).alias("n_pass"), (k % 3).alias("n_fail")), ["F", "O"], "o_orderstatus")


@query("first_model", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 4 > 1) AS model FROM orders GROUP BY 1")
def first_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", k, F.when(k % 4 == 0, "").when(k % 4 > 1, F.col("o_orderpriority")).alias("model"))
    return audit.first_given(o, ["o_custkey"], "model", "o_orderkey")


@query("build_summary", "SELECT count(DISTINCT user_id) AS specs, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors, min(user_id) FILTER (event_type = 'error') AS first_failed FROM events")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.build_summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("canonical_name"), (F.col("event_type") != "error").alias("success")))


@query("first_target", "SELECT s_suppkey, n_nationkey AS driver, t.target FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS target FROM customer WHERE c_acctbal > 5000 GROUP BY 1) t ON t.c_nationkey = n_nationkey")
def first_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("driver"), F.col("c_custkey").alias("target"), F.col("c_custkey").alias("ord"))
    return audit.with_target(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("driver")), targets).select("s_suppkey", "driver", "target")


@query("wave_members", """
SELECT w.wave, e.spec FROM (SELECT DISTINCT user_id::VARCHAR AS spec, CASE WHEN user_id % 2 = 0 THEN 'node' ELSE 'ctypes' END AS backend FROM events) e
JOIN (VALUES ('named', 1), ('node', 2), ('digits', 3)) w(wave, k) ON (k = 1 AND spec IN ('3', '4', '5')) OR (k = 2 AND backend = 'node' AND spec NOT IN ('2', '10')) OR (k = 3 AND regexp_matches(spec, '^1.$') AND backend = 'ctypes')""")
def wave_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = [("named", ["3", "4", "5"], None, None, None, None), ("node", None, "node", "javascript", ["2", "10"], None), ("digits", None, None, "c", None, "^1.$")]
    defined = spark.createDataFrame(waves, "wave string, names array<string>, wave_backend string, wave_lang string, exclude array<string>, pattern string")
    backend = F.when(F.col("user_id") % 2 == 0, "node").otherwise("ctypes")
    specs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("spec"), backend.alias("backend"), packages.backend_language(backend).alias("backend_lang")).distinct()
    return audit.in_waves(specs, defined, audit.wave_match()).select("wave", "spec")


@query("dependency_fill", """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'freebsd_ports' ELSE 'nixpkgs' END AS eco, o_orderkey % 7 = 0 AS has, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_custkey::VARCHAR END AS attr FROM orders),
e AS (SELECT c_custkey::VARCHAR AS attr, c_nationkey AS n FROM customer WHERE c_custkey % 3 <> 0)
SELECT k, CASE WHEN eco <> 'nixpkgs' OR has THEN 'skipped' WHEN e.attr IS NULL THEN 'failed' ELSE 'filled' END AS outcome, CASE WHEN eco <> 'nixpkgs' OR has THEN CASE WHEN has THEN 'own' ELSE '' END WHEN e.attr IS NULL THEN '' ELSE 'n' || n END AS build,
  CASE WHEN eco <> 'nixpkgs' OR has OR r.attr = '' THEN 'other;deps not extracted (infinite recursion)' WHEN e.attr IS NULL THEN 'other;dep fill failed (eval timeout or error)' ELSE 'other' END AS warnings FROM r LEFT JOIN e ON e.attr = r.attr""")
def dependency_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    records = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 11 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("attr"), F.struct(F.when(k % 5 == 0, "freebsd_ports").otherwise("nixpkgs").alias("ecosystem")).alias("identity"),
        F.struct(F.when(k % 7 == 0, F.array(F.lit("own"))).otherwise(none).alias("build"), none.alias("host"), none.alias("runtime"), none.alias("test")).alias("dependencies"),
        F.struct(F.array(F.lit("other"), F.lit("deps not extracted (infinite recursion)")).alias("warnings")).alias("provenance"),
    )
    results = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("attr"), F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("build"), none.alias("host"), none.alias("runtime"))
    return fill.filled(records, results).select("k", "outcome", F.array_join("dependencies.build", ",").alias("build"), F.array_join("provenance.warnings", ";").alias("warnings"))


@query("port_records", """
WITH p AS (SELECT p_partkey AS k, p_name AS n, p_size AS z FROM part),
f AS (SELECT k, n || '-' || k AS name, CASE WHEN z % 4 = 0 THEN 'unknown' ELSE z || '.' || (k % 10) END AS version, CASE WHEN k % 6 = 0 THEN 'cmake' WHEN k % 6 = 1 THEN 'perl' WHEN k % 6 = 2 THEN 'meson' ELSE 'freebsd_ports_make' END AS build_system,
  k % 3 = 0 AS lic, k % 4 = 0 AS www, k % 5 = 0 AS deprecated FROM p),
g AS (SELECT *, 2 + lic::INT + 2 * www::INT + (version <> 'unknown')::INT AS found FROM f)
SELECT k, name, version, build_system, deprecated, concat_ws(',', CASE WHEN NOT www THEN 'WWW' END, CASE WHEN NOT lic THEN 'LICENSE' END, CASE WHEN NOT www THEN 'MASTER_SITES' END) AS unmapped,
  CASE WHEN version = 'unknown' THEN (([0, 0, 68, 75, 82, 88, 95][found + 1] * 95 * 2 + 100) // 200)::BIGINT ELSE [0, 0, 68, 75, 82, 88, 95][found + 1]::BIGINT END AS confidence_pct FROM g""")
def port_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makefiles written from parts, read into records."""
    k, z = F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    line = lambda when, *parts: F.when(when, text(*parts)).otherwise("")
    value = text(
        "PORTNAME=\t", F.col("p_name"), "-", k.cast("string"), "\nCOMMENT=\tA port\n", line(z % 4 != 0, "PORTVERSION=\t0\nPORTVERSION?= ", z.cast("string"), ".", (k % 10).cast("string"), "\n"),
        line(k % 6 == 0, "USES=\tpkgconfig \\\n\tcmake:insource perl5\n"), line(k % 6 == 1, "USES=\tcargo perl5\n"), line(k % 6 == 2, "USES+=\tmeson\n"), line(k % 6 == 3, "USES=\tqmake\n"), line(k % 3 == 0, "LICENSE=\tMIT BSD\n"), line(k % 4 == 0, "WWW=\thttps://w\n"), line(k % 5 == 0, "DEPRECATED=\tyes\n"),
    )
    ports = table(spark, sf_dir, "part").select(k.cast("string").alias("dir"), recipes.make_variables(value).alias("vars"))
    found = recipes.port_recipes(recipes.inherited(ports))
    return found.select(F.col("dir").cast("long").alias("k"), "name", "version", "build_system", "deprecated", F.array_join("unmapped", ",").alias("unmapped"), F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct"))


@query("npm_records", """
SELECT c_custkey AS k, '@s/' || c_custkey AS id, 's__' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN '9.0.' || c_nationkey ELSE '10.0.' || c_nationkey END AS version, CASE WHEN c_custkey % 3 = 0 THEN 'MIT' ELSE 'ISC' END AS licence,
  CASE WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE '' END AS runtime_deps, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 't' END AS build_deps, 'https://github.com/s/' || c_custkey AS repository FROM customer""")
def npm_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers: every third has its latest version tagged, others tag a version that is not there or none."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    tag = F.when(k % 3 == 0, text('{"latest": "9.0.', n, '"}')).when(k % 3 == 1, '{"latest": "11"}').otherwise("{}")
    value = text('{"name": "@s/', k.cast("string"), '", "dist-tags": ', tag, ', "versions": {"9.0.', n, '": {"license": {"type": "MIT"}, "dependencies": {"a": "1", "b": "2"}}, "10.0.', n, '": {"license": "ISC", "devDependencies": {"t": "*"}}}, "repository": {"url": "git+https://github.com/s/', k.cast("string"), '.git"}}')
    found = recipes.npm_documents(table(spark, sf_dir, "customer").select(value.alias("value")))
    return found.select(F.split_part("ecosystem_id", F.lit("/"), F.lit(2)).cast("long").alias("k"), F.col("ecosystem_id").alias("id"), "name", "version", F.get("licenses", 0).alias("licence"), *_joined("runtime_deps", "build_deps"), "repository")


@query("quantized", "SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_quantity * l_discount)::DECIMAL(18,4), 1)::DECIMAL(18,1)::VARCHAR AS half_even, round((l_quantity * l_discount)::DECIMAL(18,4), 1)::DECIMAL(18,1)::VARCHAR AS half_up FROM lineitem")
def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_quantity") * F.col("l_discount")).cast("decimal(18,4)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[texts.quantized(x, 1, m).cast("decimal(18,1)").cast("string").alias(m) for m in ("half_even", "half_up")])


@query("fractions", "SELECT p_partkey, p_size // gcd(p_size, p_partkey + 1) AS num, (p_partkey + 1) // gcd(p_size, p_partkey + 1) AS den, (p_size * 3 + p_partkey + 1) // gcd(p_size * 3 + p_partkey + 1, (p_partkey + 1) * 3) AS sum_num FROM part")
def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes over keys in lowest terms, and with a third added."""
    f = texts.fraction(F.col("p_size"), F.col("p_partkey") + 1)
    third = F.struct(F.lit(1).cast("bigint").alias("num"), F.lit(3).cast("bigint").alias("den"))
    return table(spark, sf_dir, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.num", "f.den", texts.fraction_sum(F.col("f"), third)["num"].alias("sum_num"))


@query("csv_lines", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '"' || c_name || ', ' || repeat('"', 2) || c_mktsegment || repeat('"', 3) ELSE c_name END || ',' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END || ',' || c_nationkey AS line, TRUE AS same FROM customer""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines with quoted fields, and read again."""
    k = F.col("c_custkey")
    fields = F.array(F.when(k % 3 == 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))).otherwise(F.col("c_name")), F.when(k % 2 == 1, F.col("c_mktsegment")), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", fields.alias("f"), texts.csv_line(fields).alias("line"))
    return rows.select("c_custkey", "line", (texts.csv_fields(F.col("line")) == F.transform("f", lambda x: F.coalesce(x, F.lit("")))).alias("same"))


@query("query_values", r"""
SELECT page_id, count(*) AS n_values, string_agg(k || '=' || v, '&' ORDER BY k, i) AS sorted FROM (SELECT page_id, i, split_part(p, '=', 1) AS k, substr(p, strpos(p, '=') + 1) AS v FROM (
  SELECT page_id, unnest(string_split(q, '&')) AS p, unnest(range(len(string_split(q, '&')))) AS i FROM (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)) WHERE contains(p, '=') AND NOT ends_with(p, '=')) GROUP BY 1""")
def query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the queries of addresses by name, in order."""
    found = table(spark, sf_dir, "pages").select("page_id", texts.query_values(scalars.url_query(F.col("url"))).alias("m"))
    flat = F.flatten(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.transform(F.element_at("m", k), lambda v: F.concat_ws("=", k, v))))
    return found.select("page_id", F.size(flat).cast("long").alias("n_values"), F.array_join(flat, "&").alias("sorted")).where("n_values > 0")


@query("sliced", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n >= 2 AND n < 20 AND (n - 2) % 3 = 0")
def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sliced(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 2, 20, 3).select("event_id")


@query("zipped", """
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS n FROM events WHERE event_type IN ('click', 'purchase'))
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, b.n) AS n, coalesce(a.event_id, -1) AS click, coalesce(b.event_id, -1) AS purchase FROM (SELECT * FROM e WHERE event_type = 'click') a FULL JOIN (SELECT * FROM e WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.n = b.n""")
def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(f"ts_{kind}"), F.col("event_id").alias(kind))
    return sequences.zipped(of("click"), of("purchase"), ["user_id"], ["ts_click", "click"], ["ts_purchase", "purchase"]).select("user_id", F.col("at").alias("n"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("click", "purchase")])


@query("smallest_largest", "SELECT 'low' AS side, p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 15) UNION ALL SELECT 'high', p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 15)")
def smallest_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return sequences.smallest(p, 15, "p_size", "p_partkey").select(F.lit("low").alias("side"), "p_partkey").union(sequences.largest(p, 15, "p_size", "p_partkey").select(F.lit("high"), "p_partkey"))


@query("utc_fields", "SELECT event_id, year(ts)::INT AS year, dayofyear(ts)::INT AS yearday, hour(ts)::INT AS hour, second(ts)::INT AS second, (isodow(ts) - 1)::INT AS weekday, epoch(date_trunc('second', ts))::BIGINT AS back FROM events")
def utc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as fields in UTC and back."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    f = lambda c: F.col(f"f.{c}")
    rows = table(spark, sf_dir, "events").select("event_id", texts.utc_fields(seconds).alias("f"))
    return rows.select("event_id", "f.year", "f.yearday", "f.hour", "f.second", "f.weekday", texts.from_utc_fields(*map(f, ("year", "month", "day", "hour", "minute", "second"))).cast("bigint").alias("back"))


@query("license_expressions", """
WITH v AS (SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, TRUE), (3, NULL), (4, FALSE), (5, TRUE)) t(i, ok)),
p AS (SELECT p_partkey, p_size % 3 AS op, a.ok AS a, b.ok AS b FROM part JOIN v a ON a.i = p_partkey % 6 JOIN v b ON b.i = (p_partkey // 6) % 6)
SELECT p_partkey, CASE WHEN ok THEN 'yes' WHEN NOT ok THEN 'no' ELSE 'unknown' END AS permissive FROM (SELECT p_partkey, CASE op WHEN 0 THEN a WHEN 1 THEN a AND b ELSE CASE WHEN a OR b THEN TRUE WHEN NOT a OR NOT b THEN FALSE END END AS ok FROM p)""")
def license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two licences of six a part, alone, both asked for, or either one: a known good, a known bad or an unknown answer."""
    names = F.array(*map(F.lit, ("MIT", "LGPL-2.1", "Apache-2.0", "Custom", "AGPL-3.0", "BSD-2-Clause")))
    a, b = F.get(names, (F.col("p_partkey") % 6).cast("int")), F.get(names, F.pmod(F.floor(F.col("p_partkey") / 6), F.lit(6)).cast("int"))
    op = F.col("p_size") % 3
    verdict = packages.permissive(F.when(op == 0, a).when(op == 1, F.concat_ws(" AND ", a, b)).otherwise(F.concat_ws(" or ", a, b)))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(verdict, "yes").when(~verdict, "no").otherwise("unknown").alias("permissive"))


@query("address_ranges", """
WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761 + o_custkey * 40503) % 4294967296 AS n FROM orders)
SELECT o_orderkey, n // 16777216 = 10 OR n // 1048576 = 172 * 16 + 1 OR n // 65536 = 192 * 256 + 168 OR n // 16777216 = 127 AS private, n // 2097152 = (n // 16777216) * 8 + 3 AS third_of_eight FROM a""")
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses spread over all of IPv4 by keys: whether they are private, and in the fourth eighth of their first part's network (96 to 127)."""
    n = F.pmod(F.col("o_orderkey") * 2654435761 + F.col("o_custkey") * 40503, F.lit(4294967296))
    part = lambda size: F.pmod(F.floor(n / size), F.lit(256)).cast("string")
    address = F.concat_ws(".", part(16777216), part(65536), part(256), part(1))
    second = F.floor(F.pmod(scalars.ipv4_number(address), F.lit(16777216)) / 2097152)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.is_private_ipv4(address).alias("private"), (second == 3).alias("third_of_eight"))


@query("digests", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN md5(c_name) WHEN 1 THEN sha1(c_name) WHEN 2 THEN sha256(c_name || c_mktsegment) END AS digest, c_custkey % 4 < 3 AND c_custkey % 5 <> 0 AS passed FROM customer")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by three algorithms and one that is unknown, the third in two parts; every fifth customer expects another digest."""
    k = F.col("c_custkey") % 4
    algorithm = F.when(k == 0, "md5").when(k == 1, "sha1").when(k == 2, "sha256").otherwise("crc")
    parts = F.when(k == 2, F.array("c_name", "c_mktsegment")).otherwise(F.array("c_name"))
    found = evaluate.digest(algorithm, F.array_join(parts, "").cast("binary"))
    wanted = F.when(F.col("c_custkey") % 5 == 0, F.reverse(found)).otherwise(found)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("digest"), evaluate.same_in_parts(algorithm, F.transform(parts, lambda p: p.cast("binary")), wanted).alias("passed"))


from lodemill.plans import source_queries  # noqa: E402, F401  it registers its own

"""Sharding, periodic runs, conversation tries and the quality queries against brute force, on small tables."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.llm import conversation_trie, mixing, periodic_runs, quality_model, quality_rules, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, **tables):
    """A folder of Parquet tables, as the queries read them."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def differenced(sizes, k):
    """Karmarkar-Karp over lists of (sum, members), by definition."""
    heap = [(-s, n, [(s, [i])] + [(0, [])] * (k - 1)) for n, (i, s) in enumerate(enumerate(sizes))]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: -x[0])
        least = both[-1][0]
        n += 1
        heapq.heappush(heap, (-(both[0][0] - least), n, [(s - least, m) for s, m in both]))
    return sorted(sum(sizes[i] for i in m) for _, m in heap[0][2]) if heap else []


@pytest.mark.parametrize("k", [1, 2, 8])
def test_differencing_equals_definition(k):
    r = random.Random(k)
    for n in (0, 1, 2, 7, 300):
        sizes = sorted((r.choice([1, r.randint(1, 50), r.randint(1, 5000)]) for _ in range(n)), reverse=True)
        shards = sharding.difference(sizes, k)
        sums = sorted(sum(s for s, x in zip(sizes, shards) if x == j) for j in range(k)) if n else []
        want = differenced(sizes, k)
        assert len(shards) == n and (not n or max(sums) - min(sums) <= max(sizes))
        assert [s - min(sums) for s in sums] == [s - min(want) for s in want] if n else sums == want
    assert max(sums) - min(sums) <= 10  # 300 items: far below the largest


def check_shards(rows):
    by_shard, of_text = {}, {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
        of_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    return {s: sum(r.size for r in v) for s, v in by_shard.items()}


def test_sharding_query(spark, tmp_path):
    r = random.Random(2)
    texts = [(i, "w" * r.choice([0, 3, r.randint(0, 90), r.randint(0, 4000)])) for i in range(900)] + [(None, None), (None, "é"), (None, "é"), (5, "w" * 3), (5, "w" * 3)] + [(1000 + i, "hot " * 20) for i in range(400)]
    at = folder(spark, tmp_path, documents=([(i, t, "en", "s", 1) for i, t in texts], DOCS))
    rows = sharding.op13_shard_bytes(spark, at).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    sums = check_shards(rows)
    assert max(sums.values()) - min(sums.values()) <= 81 and len(sums) == 8
    again = sharding.op13_shard_bytes(spark, at).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_sharding_with_bundles(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "w" * (i % 37), i) for i in range(3000)] + [(9999, "x" * 20000, 0)], "doc_id long, text string, shard long")
    rows = sharding.assigned(docs, 4, 500).collect()
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert len(rows) == 3001 and max(sums) - min(sums) < sum(sums) // 100
    assert sharding.assigned(docs.limit(0)).count() == 0


def test_shards_as_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w" * (i % 37), i) for i in range(300)], "doc_id long, text string, shard long")
    sharding.write(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*docs.columns, "_shard"] and sorted(back.drop("_shard").collect()) == sorted(docs.collect())
    assert {r[0] for r in back.select("_shard").distinct().collect()} == {0, 1, 2, 3}


def runs_by_definition(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(12, 2 * q) and not any(w[s : s + length - r] == w[s + r : s + length] for r in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out)


def test_runs_equal_definition():
    r = random.Random(1)
    for _ in range(600):
        n, kind = r.randint(0, 90), r.choice([1, 2, 3, 50])
        w = [r.randrange(kind) for _ in range(n)]
        if r.random() < 0.5 and n:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periodic_runs.runs_of(np.array(w, dtype=np.int64)) == runs_by_definition(w)


def test_runs_where_hashes_clash(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mix", lambda x: np.zeros(len(x), dtype=np.uint64))  # everything agrees by hash
    monkeypatch.setattr(periodic_runs, "GRID", 16)
    r = random.Random(4)
    for _ in range(60):
        w = [r.randrange(2) for _ in range(r.randint(0, 60))]
        assert periodic_runs.runs_of(np.array(w, dtype=np.int64)) == runs_by_definition(w)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_runs_query(spark, tmp_path):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(k)}" for _ in range(n)) for k, n in [(2, 200), (3, 80), (500, 150)] * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3]), (70, None), (71, ""), (72, " \n\x0b"), (73, "é\u00a0é " * 30), (74, "a b " * 4000), (75, "x")]
    got = periodic_runs.op12_periodic_runs(spark, folder(spark, tmp_path, documents=([(i, t, "en", "s", 1) for i, t in rows], DOCS))).collect()
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = [(0, n, 2)] if i == 74 and h % 10 else runs_by_definition(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        gone = {j for s, e, q in runs for j in range(s + q, s + e)}
        lines = "".join(f"{s},{e},{q}\n" for s, e, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)) > 2 and sum(x[1] > 1 for x in want) > 10


def test_periodic_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, 7)], "doc_id long, text string, runs long")
    row = docs.withColumn("x", periodic_runs.periodic("text")).first()
    assert row.runs == 7 and [tuple(x) for x in row.x.runs] == [(0, 16, 2)] and row.x.collapsed == "a b" and row.x.n_words == 16
    assert docs.limit(0).withColumn("x", periodic_runs.periodic("text")).count() == 0


TALK = "conv_id long, turn long, role string, text string"


def tries_by_definition(rows):
    """Rows of the query from lists of rebuilt conversations."""
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")[:32]
            told.setdefault(c, []).append(((turn is not None, turn or 0, key), (role or "", text or "")))
    told = {c: [x for _, x in sorted(v)] for c, v in told.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(told.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])  # the remainder has the sign of c
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, out = {}, []
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    below = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * words(path)
        under = [below[k] for k in kids.get(path, [])]
        below[path] = (own + sum(x[0] for x in under), sum(x[1] for x in under) or 1)
        ends = ",".join(str(c) for c in sorted(members[path]) if built[c] == path)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(kids.get(path, [])), below[path][1], below[path][0], sha(ends)))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(r, n, most, kinds):
    return [(c, t, r.choice(["user", "assistant", None]), " ".join(["w"] * r.randrange(kinds)) or None) for c in range(n) for t in range(r.randint(1, most))]


def test_conversation_trie_query(spark, tmp_path):
    r = random.Random(11)
    rows = talks(r, 60, 6, 3) + [(c, t, "user", "same words") for c in range(100, 160) for t in range(4)] + [(300, t, "u", f"long {t % 5}") for t in range(400)]
    rows += [(300 + k, t, "u", f"long {t % 5}") for k in range(1, 9) for t in range(k * 3)]  # each goes on from the one before: a deep tree of chains
    rows += [(None, 1, "a", "b"), (7, None, "a", "b"), (7, 0, "a", "b"), (7, 0, "a", "b"), (7, 0, "b", "a"), (-3, 1, "a", "b"), (-23, 1, None, None), (405, 1, "", "one turn"), (406, 2, "", "two")]
    got = conversation_trie.op11_conversation_trie(spark, folder(spark, tmp_path, conversations=(rows, TALK)))
    assert sorted((tuple(x[c] for c in COLUMNS) for x in got.collect()), key=str) == tries_by_definition(rows)


def test_conversation_trie_of_chains_that_hang_deep(spark, tmp_path):
    rows = [(20 * k, t, "u", f"turn {t}") for k in range(40) for t in range(k + 4)]
    got = conversation_trie.op11_conversation_trie(spark, folder(spark, tmp_path, conversations=(rows, TALK))).collect()
    assert sorted((tuple(x[c] for c in COLUMNS) for x in got), key=str) == tries_by_definition(rows)


def test_conversation_trie_of_nothing(spark, tmp_path):
    got = conversation_trie.op11_conversation_trie(spark, folder(spark, tmp_path, conversations=([(None, 1, "a", "b")], TALK)))
    assert got.count() == 0 and sorted(got.columns) == sorted(COLUMNS)


def test_lists_hashed_in_pieces(spark):
    ends = spark.range(5000).selectExpr("5L as conv_id", "2L as depth", "id * 3 as member").unionByName(spark.range(3).selectExpr("id as conv_id", "1L as depth", "id as member"))
    got = {(x.conv_id, x.depth): x.ends_sha256 for x in conversation_trie.list_hashes(ends, 100).collect()}
    assert got == {(5, 2): sha(",".join(str(i * 3) for i in range(5000)))} | {(i, 1): sha(str(i)) for i in range(3)}


def test_mixing_of_many_equal_rows(spark, tmp_path):
    """200,000 equal rows without an id: no task makes or numbers them all, and all are there."""
    same = spark.range(200_000, numPartitions=4).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one two three' AS text", "'en' AS lang", "'a' AS source", "13L AS n_chars")
    rest = spark.range(3000, numPartitions=2).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 50 AS INT)) AS text", "'en' AS lang", "'b' AS source", "1L AS n_chars")
    docs = same.unionByName(rest)
    rows = mixing.mix(docs)
    assert rows.count() == 203_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = mixing.mix(docs).where("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 150_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    taken = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 60 for r in taken)
    out = mixing.repeated(docs)
    assert out.where("source = 'a'").count() * 3 == next(r.n for r in taken if r.source == "a") and out.columns == docs.columns
    by_id = {r.doc_id: r["count"] for r in out.where("source = 'b'").groupBy("doc_id").count().collect()}
    assert by_id == {r.doc_id: r.repeats for r in rows.where("source = 'b' AND repeats > 0 AND size > 0").collect()}


def test_conversation_trie_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    got = conversation_trie.op11_conversation_trie(spark, "/root/testdata/sf0.001")
    want = con.sql(conversation_trie.OP11_SQL)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(x[c] for c in want.columns) for x in got.collect()), key=str) == sorted(want.fetchall(), key=str)


LABELS = "doc_id long, quality int, toxic int"
WORD = r"[^\x20\x09-\x0D]+"


def rated_documents(r):
    """Documents of three kinds with labels, and odd ones: null, empty, white, repeated rows and ids, one long line, many lines."""
    good = lambda: "\n".join(" ".join(r.choice(["the", "river", "runs", "over", "stones", "and", "a", "house", "stands", "near"]) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(8, 15))) for _ in range(r.randint(3, 6)))
    junk = lambda: "\n".join(r.choice(["| Home | Login |", "$$$ >>> BUY", "# # #", "Home", "click <here> & win"]) for _ in range(r.randint(8, 20)))
    bad = lambda: good() + "\n" + " ".join(r.choice(["vile", "nasty"]) for _ in range(6))
    rows = [(i, (good, junk, bad)[i % 3]()) for i in range(120)]
    labels = [(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(90)] + [(None, 1, 0), (5, None, None), (999, 1, 0)]
    again = "one two three four five six seven eight nine ten " * 4
    odd = [None, "", " \t\n\x0b", "few words", again, again.replace(" ", "\n"), "é\u00a0é * " * 20, "x " * 4000, "w\n" * 3000]
    rows += [(200 + i, t) for i, t in enumerate(odd)] + [(None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (3, "another text under an id that is there")]
    return rows, labels


def test_quality_rules_query(spark, tmp_path):
    rows, labels = rated_documents(random.Random(8))
    at = folder(spark, tmp_path, documents=([(i, t, "en", "s", 1) for i, t in rows], DOCS), labels=(labels, LABELS))
    got = quality_rules.op6_quality_rules(spark, at).collect()
    crf = quality_rules.fit(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{at}/labels.parquet"))
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(WORD, t)
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        inside = {j + k for j, g in enumerate(grams) if count[g] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        verdict = quality_rules.judged([t], crf)[0][-1] >= quality_rules.MIN_CONTENT * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed, not failed and verdict))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(x[c] for c in columns) for x in got), key=str) == sorted(want, key=str)
    kept = {x.doc_id: x.kept for x in got if x.doc_id is not None and 90 <= x.doc_id < 120 and not x.base_failed}
    assert sum(v == (i % 3 != 1) for i, v in kept.items()) >= 0.9 * len(kept) > 5  # documents without labels


def test_quality_grades_query(spark, tmp_path):
    rows, labels = rated_documents(random.Random(9))
    at = folder(spark, tmp_path, documents=([(i, t, "en", "s", 1) for i, t in rows], DOCS), labels=(labels, LABELS))
    got = quality_model.op8_quality_grades(spark, at).collect()
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    model = quality_model.fit(docs, quality_model.grades_of_labels(spark.read.parquet(f"{at}/labels.parquet")), 3)
    want = []
    for i, t in rows:
        buckets, n = quality_model.bucket_counts(t or "")
        score = sum(float(model.weights[b]) * math.log1p(c) for b, c in zip(buckets, n))
        tails = [1 / (1 + math.exp(float(cut) - score)) for cut in model.thresholds]
        want.append((i, round(sum(tails), 9), round(tails[-1], 9), tails[-1] >= quality_model.SELECT))
    assert sorted(((x.doc_id, round(x.expected_grade, 9), round(x.p_good, 9), x.kept) for x in got), key=str) == sorted(want, key=str)
    assert all(0 <= x.p_good <= x.expected_grade / 2 + 1e-12 <= 1.1 for x in got)
    grade = {x.doc_id: x.expected_grade for x in got if x.doc_id is not None and 90 <= x.doc_id < 120}
    mean = [sum(v for i, v in grade.items() if i % 3 == k) / 10 for k in range(3)]
    assert mean[0] > mean[2] > mean[1]  # good, toxic, junk

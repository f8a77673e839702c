"""Queries that have no SQL, and operators by themselves, against loops and literals."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemosaic.functions import seams, text
from mnemosaic.operators import graph, search, windows
from mnemosaic.plans.registry import QUERIES
from mnemosaic.sources import io

DIR = "/root/testdata/sf0.001"


def test_explored_weights_keep_sums_and_bounds(spark):
    rows = [r.weights for r in QUERIES["m18_explored_weights"](spark, DIR).collect()]
    moved = [w for w in rows if list(w) != [0.40, 0.25, 0.20, 0.15]]
    assert 0.05 * len(rows) < len(moved) < 0.16 * len(rows)
    assert all(abs(sum(w) - 1) < 1e-9 and all(abs(a - b) < 0.1 for a, b in zip(w, [0.40, 0.25, 0.20, 0.15])) for w in moved)


def test_embedders_fail_over(spark):
    for r in QUERIES["r21_failover"](spark, DIR).collect():
        if r.n % 2:
            assert list(r.vector) == [float(r.n)]
        else:
            assert len(r.vector) == 64 and math.isclose(sum(x * x for x in r.vector), 1.0, rel_tol=1e-9)
    df = spark.createDataFrame([("[1", ), ('x [{"type":"a","content":"b"}] y',), (None,)], "t string")
    got = [r.f for r in df.select(seams.judged(F.col("t"), lambda t: t).alias("f")).collect()]
    assert [len(f) for f in got] == [0, 1, 0] and got[1][0].content == "b"
    assert [r.f for r in df.select(seams.judged(F.col("t")).alias("f")).collect()] == [[], [], []]


def test_rerank_by_a_model(spark):
    rows = QUERIES["seam_rerank"](spark, DIR).collect()
    best = defaultdict(list)
    for r in rows:
        best[r.qid].append((r["rank"], r.score))
    assert best and all([s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in best.values())


def test_session_extraction_against_a_loop(spark, tmp_path):
    rnd = random.Random(3)
    said = ["用户喜欢川菜和粤菜的味道", "我们决定用红色的按钮", "好的", "deadline is on friday", "用户喜欢川菜和粤菜的味道", "nothing to see here", None]
    rows = [(c, t, rnd.choice(("user", "assistant", "human")), rnd.choice(said)) for c in range(12) for t in range(rnd.randrange(1, 14))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter((r.conv_id, r.turn, r.type, r.content) for r in QUERIES["t8_session_extraction"](spark, str(tmp_path)).collect())
    facts = {r.q: [(x.type, x.content) for x in r.f] for r in spark.createDataFrame([(x,) for x in said if x], "q string").select("q", text.quick_extract(F.col("q")).alias("f")).collect()}
    want = Counter()
    for c in range(12):
        seen = set()
        for t, x in sorted(((t, x) for k, t, role, x in rows if k == c and role != "assistant"), key=lambda v: v[0])[-6:]:
            for kind, content in facts.get(x, []):
                if content not in seen:
                    seen.add(content)
                    want[c, t, kind, content] += 1
    assert got == want and want


def test_store_chain_outcomes(spark):
    v = [[1.0, 0.0], [0.0, 1.0]]
    kept = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "something else that is stored")], "id long, content string")
    new = [
        (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0.8), (12, "alpha beta gamma delta epsilon zeta eta theta", 0.8), (13, "a text of its own, near by vector", 0.8), (14, "a text of its own, near by vector", 0.8),
        (15, "short", 0.8), (16, "unimportant but long enough", 0.1), (17, "recalled a moment ago, word for word", 0.8), (18, "with\x07 a bell in it, and no vector", 0.5),
    ]
    df = spark.createDataFrame([(i, c, "fact", w, f"2024-01-{i:02d}") for i, c, w in new], "id long, content string, type string, importance double, created_at string")
    vectors = spark.createDataFrame([(1, v[0]), (2, v[1]), *((i, v[0]) for i in range(11, 18))], "id long, vector array<double>")
    recalled = spark.createDataFrame([("recalled a moment ago, word for word",)], "c string").select(F.sha2("c", 256).alias("hash"))
    got = {r.id: (r.outcome, r.match) for r in search.admitted(df, kept, vectors, recalled).collect()}
    assert {i: o for i, (o, _) in got.items()} == {11: "skip", 12: "merge", 13: "created", 14: "repeated", 15: "short", 16: "importance", 17: "recalled", 18: "created"}
    assert got[12][1] == 1 and got[18][1] is None
    table = {r.id: r for r in QUERIES["s5_appended"](spark, DIR).collect()}
    outcomes = Counter(r.outcome for r in QUERIES["s5_store_chain"](spark, DIR).collect())
    assert len(table) == 180 + outcomes["created"]


def test_mmr_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(q, "a b c d", i, " ".join(rnd.choice("abcdefgh") for _ in range(6)), i) for q in range(4) for i in range(12)]
    got = defaultdict(list)
    for r in search.mmr(spark.createDataFrame(rows, "qid long, q string, id long, content string, pos int"), 6, order="pos").orderBy("qid", "pos").collect():
        got[r.qid].append(r.id)
    sim = lambda a, b: len(a & b) / len(a | b)
    for q in range(4):
        sets, chosen = {i: set(c.split()) for k, _, i, c, _ in rows if k == q}, []
        while len(chosen) < 6:
            best = None
            for i in sorted(sets):
                if i not in chosen:
                    near = max((sim(sets[i], sets[j]) for j in chosen), default=0.0)
                    value = (0.5 * sim(set("abcd"), sets[i]) + 0.5 * (1 - near)) * (0.5 if near > 0.85 else 1)
                    if best is None or value > best[0]:
                        best = (value, i)
            chosen.append(best[1])
        assert got[q] == chosen


def test_classes_of_long_chains_settle(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(500, 400), (600, 600)]
    got = {r.node: r.root for r in graph.equivalence(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 500: 400, 600: 600}


def test_running_stats_and_repeats_of_one_hot_key(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("aaab"), 1_700_000_000 + rnd.randrange(4 * 86_400), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r for r in windows.running_stats(df, "k", "ts", "id", "v", slices=7).collect()}
    for i, k, s, _ in rows:
        before = [v for j, k2, s2, v in rows if k2 == k and (s2, j) <= (s, i)]
        assert got[i].running_n == len(before) and got[i].running_min == min(before) and got[i].running_max == max(before) and got[i].running_avg == pytest.approx(sum(before) / len(before))
    counts = {r.id: r.repeats for r in windows.repeats_before(df, "k", "ts").collect()}
    assert counts == {i: sum(k2 == k and s - 86_400 <= s2 < s for _, k2, s2, _ in rows) for i, k, s, _ in rows}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda k, default=None: default)

    with pytest.raises(ValueError):
        io.shared_dir(Session())


def test_best_bm25_equals_all_pairs_cut(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: rnd.choice(("ab", "cd", "ef", "gh", "x1", "y_2", "zz"))
    docs = spark.createDataFrame([(f"d{i}", " ".join(word() for _ in range(rnd.randrange(0, 9)))) for i in range(80)] + [("n", None)], "id string, content string")
    queries = spark.createDataFrame([(i, " ".join(word() for _ in range(3))) for i in range(11)] + [(50, "unknown"), (51, "")], "qid long, q string")
    for variant in ("module", "core"):
        whole = search.top(search.bm25(docs, queries, variant=variant).withColumn("score", F.round("score", 4)), 5)
        want = sorted((r.qid, r["rank"], r.id, r.score) for r in whole.collect())
        for at_once in (512, 3):
            monkeypatch.setattr(search, "QUERIES_AT_ONCE", at_once)
            got = search.bm25_top(docs, queries, 5, variant=variant).collect()
            assert sorted((r.qid, r["rank"], r.id, r.score) for r in got) == want and want
    assert search.bm25_top(docs, queries.limit(0), 5).count() == 0


def test_lengths_are_counted_once_for_each_text(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(n)) + " w1" * more for n, more in ((3000, 2), (5, 0), (0, 3), (40, 40))] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    plans, plain = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().split("\n")) or plain(df))
    hits, stats = search._hits(docs, spark.createDataFrame([("w1",), ("w39",)], "term string"), "core", "id", "content")
    assert {(r.id, r.term, r.tf, r.dl) for r in hits.collect()} == {(0, "w1", 3, 3000), (0, "w39", 1, 3000), (1, "w1", 1, 5), (2, "w1", 3, 1), (3, "w1", 41, 40), (3, "w39", 1, 40)}
    assert tuple(stats.first()) == (6, 3046 / 6)
    # Lower in a plan is earlier: no step on the rows of words looks at a whole text's words.
    (explode,) = [n for n, line in enumerate(plans[0]) if "Generate explode" in line]
    assert [n > explode for n, line in enumerate(plans[0]) if "array_distinct" in line] == [True]


def test_common_terms_meet_queries_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 7} text") for i in range(60)], "id long, content string")
    queries = spark.createDataFrame([(1, "common word3"), (2, "text")], "qid long, q string")
    whole = {(r.qid, r.id): round(r.score, 9) for r in search.bm25(docs, queries).collect()}
    monkeypatch.setattr(search, "PIECE", 5)
    assert whole == {(r.qid, r.id): round(r.score, 9) for r in search.bm25(docs, queries).collect()} and len(whole) == 120


def test_notes_out_and_in_by_the_command_line(spark, tmp_path):
    from mnemosaic import cli

    rows = [("a", "用户喜欢川菜\nin two lines", "preference", 0.8), ("b", "---\nodd", "fact", 0.4)]
    df = spark.createDataFrame(rows, "id string, content string, type string, importance double").withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05'"))
    df.write.parquet(f"{tmp_path}/m")
    df.limit(0).write.parquet(f"{tmp_path}/n")
    assert cli.main(["export", f"{tmp_path}/m", f"{tmp_path}/notes", "--md"], spark) == 0
    assert cli.main(["import", f"{tmp_path}/n", f"{tmp_path}/notes", "--md"], spark) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/n").collect())) == sorted(map(tuple, df.collect()))


def test_attachments_and_notes_of_a_folder(spark, tmp_path):
    import hashlib

    (tmp_path / "a.md").write_text("## Current Task\nwrite\n\n---\n")
    (tmp_path / "b.exe").write_bytes(b"x" * 2048)
    got = {r.filename: r for r in io.attachments(spark, str(tmp_path)).collect()}
    assert got["a.md"].refused is None and got["a.md"].file_type == "document" and got["b.exe"].refused == "type" and got["b.exe"].size_text == "2.0KB"
    assert got["b.exe"].hash_sha256 == hashlib.sha256(b"x" * 2048).hexdigest()
    parsed = io.parsed_sessions(io.notes(spark, str(tmp_path))).collect()
    assert [(r.path, r.current_task, r.key_context) for r in parsed] == [("a.md", "write", "[None yet]")]

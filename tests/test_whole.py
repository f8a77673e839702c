"""Queries that do the whole job, against brute force on small tables."""

import math
import re
from collections import Counter

import pytest

from mnemosaic.plans.registry import QUERIES

ITEMS = [(0, "alpha beta gamma delta epsilon zeta lighthouse keeper walks"), (1, "one two three four five six seven lighthouse"), (2, "nothing here that matches any of those unseen harbour")]
TEXTS = ["the lighthouse stands", "a keeper of bees keeper", "alpha and beta", "harbour at night", "", "seven walks"]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_bm25_scores_the_whole_query(spark, small):
    words = [re.findall("[a-z0-9]+", t) for t in TEXTS]
    df = Counter(w for t in words for w in set(t))
    mean = sum(map(len, words)) / len(words)
    want = {}
    for q, text in ITEMS:
        for i, t in enumerate(words):
            idf = lambda w: math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1)
            score = sum(idf(w) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in set(text.split()) if w in t)
            if score > 0:
                want[q, i] = score
    got = {(r.qid, r.id): r.score for r in QUERIES["a10_bm25"](spark, small).collect()}
    assert (0, 1) in want and got == pytest.approx(want, abs=1e-4)


def test_entity_memories_searches_every_name(spark, small):
    got = {r.name: (r.memories, r.first_id) for r in QUERIES["j11_entity_memories"](spark, small).collect()}
    names = {n for _, t in ITEMS for n in re.findall("[a-z]{6,}", t)}
    assert got == {n: (len(ids), ids[0]) for n in names if (ids := [i for i, t in enumerate(TEXTS) if n in t])} and "lighthouse" in got


def test_history_walk_goes_to_the_end(spark, tmp_path):
    import datetime as dt

    rows = [(i, i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 4)) for i in range(21)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    newest = {k: sorted(((t, i) for i, c, t in rows if c == k), reverse=True) for k in (0, 1)}
    want = {(k, i, step) for k, chain in newest.items() for step, (_, i) in enumerate(chain)}
    assert {tuple(r) for r in QUERIES["j16_history_walk"](spark, str(tmp_path)).collect()} == want


def test_recall_guard_admits_again_after_its_ttl(spark, tmp_path):
    import datetime as dt
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice((1, 2, None)), rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(240)), 1.0) for i in range(200)]
    rows += [(300, 9, "a", dt.datetime(2024, 1, 1), 1.0), (301, 9, "a", dt.datetime(2024, 1, 2), 1.0), (302, 9, "a", dt.datetime(2024, 1, 2, 0, 0, 0, 1), 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    want, last = Counter(), {}
    for _, u, e, ts, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if (u, e) not in last or ts - last[u, e] > dt.timedelta(hours=24):
            want[u, e] += 1
            last[u, e] = ts
    assert {(r.user_id, r.event_type): r.n for r in QUERIES["t3_t4_recall_guard"](spark, str(tmp_path)).collect()} == want and want[9, "a"] == 2


def test_auto_capture_gives_the_facts(spark, tmp_path):
    texts = ["用户喜欢川菜和粤菜的味道", "deadline is on friday, and 我们决定用红色的按钮", "ok", None, "a message that gives no facts at all"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["t1_auto_capture"](spark, str(tmp_path)).collect()
    assert {(r.turn, r.type) for r in got} >= {(0, "preference"), (1, "decision"), (1, "task_state")} and {r.turn for r in got} == {0, 1}
    assert all(r.content in texts[r.turn] and r.transcript == texts[r.turn] and r.fingerprint for r in got)


def test_backup_sort_and_recall_text_hold_all_rows(spark, tmp_path):
    n, long = 400, "a text of more than forty characters, whole to its very end"
    spark.createDataFrame([(i, f"{long} {i}", "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    at = lambda i: i % 720 + i % 48
    assert {r.id for r in QUERIES["s13_s14_incremental_backup"](spark, d).collect()} == {i for i in range(n) if at(i) > 19 * 24}
    days = sorted({at(i) // 24 for i in range(n)}, reverse=True)
    assert {(r.backup.day - 1, r.kept) for r in QUERIES["s14_backup_retention"](spark, d).collect()} == {(day, k < 7) for k, day in enumerate(days)}
    decayed = [r.decayed for r in QUERIES["k6_decay_sort"](spark, d).collect()]
    assert len(decayed) == n and decayed == sorted(decayed, reverse=True)
    got = {r.scope_id: r.recall for r in QUERIES["x19_recall_text"](spark, d).collect()}
    kinds = ["fact", "preference", "decision", "lesson", "entity", "task_state"]
    assert got == {f"s{k}": "\n".join(f"[{kinds[i % 6]}] {long} {i}" for i in range(n) if i % 7 == k) for k in range(7)}


def test_corpus_stats_have_every_term_and_the_totals(spark, small):
    words = [re.findall("[a-z0-9]+", t) for t in TEXTS]
    df = Counter(w for t in words for w in set(t))
    got = QUERIES["a9_corpus_stats"](spark, small).collect()
    assert {r.term: r.df for r in got} == df
    assert {(r.n, round(r.avgdl, 9)) for r in got} == {(len(TEXTS), round(sum(map(len, words)) / len(words), 9))}

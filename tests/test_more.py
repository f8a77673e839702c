"""Time expressions against literals, sources, cache, command line, and the keyed limiter against a brute-force version."""

import datetime as dt
import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from mnemosaic import cli
from mnemosaic.functions import temporal
from mnemosaic.operators import search, windows
from mnemosaic.plans.registry import QUERIES
from mnemosaic.sources import rest
from mnemosaic.sources.cache import ResultCache
from mnemosaic.sources.transactions import SnapshotTable
from mnemosaic.streaming import jobs

NOW = dt.datetime(2024, 2, 1, 9, 0)  # a Thursday
D = "/root/testdata/sf0.001"


def day(y, m, d, h=0, mi=0, s=0):
    return dt.datetime(y, m, d, h, mi, s)


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("昨天", day(2024, 1, 31), day(2024, 1, 31, 23, 59, 59)), ("大后天", day(2024, 2, 4), day(2024, 2, 4, 23, 59, 59)), ("上周", day(2024, 1, 22), day(2024, 1, 28, 23, 59, 59)),
        ("本周", day(2024, 1, 29), day(2024, 2, 4, 23, 59, 59)), ("上个月", day(2024, 1, 1), day(2024, 1, 31, 23, 59, 59)), ("本月", day(2024, 2, 1), day(2024, 2, 29, 23, 59, 59)),
        ("去年", day(2023, 1, 1), day(2023, 12, 31, 23, 59, 59)), ("今晚", day(2024, 2, 1, 18), day(2024, 2, 1, 23, 59, 59)), ("中午", day(2024, 2, 1, 11), day(2024, 2, 1, 13)),
        ("周四", day(2024, 2, 1), day(2024, 2, 1, 23, 59, 59)), ("周三", day(2024, 2, 7), day(2024, 2, 7, 23, 59, 59)), ("2024年3月5日", day(2024, 3, 5), day(2024, 3, 5, 23, 59, 59)),
        ("2023年12月", day(2023, 12, 1), day(2023, 12, 31, 23, 59, 59)), ("3月8日", day(2024, 3, 8), day(2024, 3, 8, 23, 59, 59)), ("2月30日", None, None), ("正月初一", None, None),
    ],
)
def test_time_ranges(spark, text, start, end):
    df = spark.createDataFrame([(f"我{text}回家",)], "t string").select(F.explode(temporal.time_expressions(F.col("t"), F.lit(NOW))).alias("x"))
    (row,) = df.collect()
    assert (row.x.text, row.x.pos) == (text, 1)
    assert (row.x.range and (row.x.range.start, row.x.range.end)) == (start and (start, end))


def test_time_expressions_in_order(spark):
    rows = spark.createDataFrame([("后天考试，大后天和张三去上海，2023年5月1日",), ("",), (None,)], "t string")
    got = [[(x.pos, x.text, x.event) for x in r.f] for r in rows.select(temporal.time_expressions(F.col("t"), F.lit(NOW)).alias("f")).collect()]
    assert [g[:2] for g in got[0]] == [(0, "后天"), (5, "大后天"), (15, "2023年5月1日")] and got[0][1][2].startswith("后天考试 张三去上海")
    assert got[1] == [] and got[2] == []


def test_contradictions_look_back_a_bounded_way(spark):
    rows = [("a", 1, "喜欢茶"), *[("a", n, "x") for n in range(2, 102)], ("a", 102, "不喜欢茶"), ("b", 1, "喜欢茶"), ("b", 2, "讨厌茶")]
    df = spark.createDataFrame(rows, "k string, n int, q string")
    got = {(r.k, r.n): r.contradicts for r in windows.contradictions(df, ["k"], "n", "q").collect()}
    assert got[("a", 102)] is None and got[("b", 2)] == 1 and got[("b", 1)] is None


def test_repeat_limiter_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(96))) for i in range(120)]
    spark.createDataFrame(rows, "row long, k string, ts timestamp").write.parquet(str(tmp_path / "m.parquet"))
    got = {r.row_id: r.admitted for r in jobs.drained(jobs.repeat_limiter(jobs.source(spark, str(tmp_path / "m.parquet")), "k", "ts", "row")).collect()}
    want, kept = {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = [t for t in kept.get(k, []) if ts - t <= dt.timedelta(hours=24)]
        want[i] = len(live) < 3
        kept[k] = live + [ts] if want[i] else live
    assert got == want


def test_rest_source(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = json.dumps({"results": [{"id": 1, "memory": f"page {self.path[-1]}"}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rest.register(spark)
        df = spark.read.format("memory_rest").option("url", f"http://127.0.0.1:{server.server_port}/{{page}}").option("pages", "2").load()
        assert sorted(tuple(r) for r in df.collect()) == [("1", "page 0", "rest"), ("1", "page 1", "rest")]
    finally:
        server.shutdown()


def test_cache_keeps_the_newest_for_a_time(spark):
    now = [0.0]
    cache = ResultCache(size=2, ttl=10, clock=lambda: now[0])
    made = []
    ask = lambda q: cache.through(lambda: made.append(q) or spark.range(1), q, k=5)
    for q in ("a", "b", "a", "c", "b"):  # b was the least recently used when c came
        ask(q)
    assert made == ["a", "b", "c", "b"] and cache.stats() == {"size": 2, "hits": 1, "misses": 4, "hit_rate": 20.0}
    now[0] = 11
    ask("b")
    assert made[-1] == "b" and len(made) == 5


def test_command_line(spark, tmp_path, capsys):
    from mnemosaic.plans.views import memories

    folder = str(tmp_path / "m")
    memories(spark, D).write.parquet(folder)
    n = spark.read.parquet(folder).count()
    assert cli.main(["export", folder, str(tmp_path / "j")], spark) == 0 and cli.main(["import", folder, str(tmp_path / "j")], spark) == 0
    assert spark.read.parquet(folder).count() == 2 * n
    assert cli.main(["delete", folder, "1", str(tmp_path / "left")], spark) == 0 and spark.read.parquet(str(tmp_path / "left")).count() == 2 * n - 2
    cli.main(["stats", folder], spark)
    cli.main(["list", folder, "-n", "3"], spark)
    cli.main(["search", folder, "the"], spark)
    assert "importance" in capsys.readouterr().out


def test_cold_storage_keeps_whole_texts(spark):
    df = QUERIES["s17_cold_roundtrip"](spark, D)
    from mnemosaic.plans.views import memories

    want = {str(r.id): r.content for r in memories(spark, D).where("importance <= 0.5").collect()}
    assert {r.id: r.content for r in df.collect()} == want


def test_mentions_by_automaton_and_by_join(spark):
    docs = spark.createDataFrame([(1, "An Apple pie, apple again"), (2, None), (3, ""), (4, "pineapple")], "id long, content string")
    names = spark.createDataFrame([("apple",), ("APPLE",), ("pie",), (None,), ("nut",), ("pine",)], "name string")
    want = {(1, "apple"), (1, "APPLE"), (1, "pie"), (4, "apple"), (4, "APPLE"), (4, "pine")}
    for most in (100, 2):
        got = [(r.id, r.name) for r in search.mentions(docs, names, most=most).select("id", "name").collect()]
        assert len(got) == len(want) and set(got) == want
    assert search.mentions(docs, names.where("false")).count() == 0


def test_vector_top_equals_brute_force(spark):
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(4)]) for i in range(40)] + [(100, None), (101, [0.0] * 4), (102, [1.0, 2.0]), (103, [None, 1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in search.vector_top(v, v.where("id < 6 or id = 102").selectExpr("id AS qid", "vector AS v"), 5, block=4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    full = {i: [x or 0.0 for x in x_] for i, x_ in rows if x_ is not None}

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) + 0.0 if len(a) == len(b) and n else 0.0

    for q in [0, 1, 2, 3, 4, 5, 102]:
        want = sorted(((-cosine(full[q], b), i) for i, b in full.items()))[:5]
        assert [(i, pytest.approx(s)) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
    assert search.vector_top(v.where("false"), v.where("id < 2").selectExpr("id AS qid", "vector AS v"), 3).count() == 0


def test_transactions(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id long, a string, b double")
    seen = lambda t, v=None: sorted(map(tuple, t.read(v).collect()), key=repr)
    t = SnapshotTable.create(make([(1, "x", 1.0), (2, "y", None), (None, "z", 3.0)]), str(tmp_path / "t"))
    with t.begin() as batch:
        batch.store(make([(3, "new", 0.5), (1, "again", 9.0)]))
        batch.update(make([(2, None, 7.0), (2, None, 5.0), (8, "nobody", 1.0)]))
        batch.delete(make([(3, None, None), (None, None, None)]))
    assert seen(t) == sorted([(1, "again", 9.0), (2, "y", 7.0), (None, "z", 3.0)], key=repr)
    before = seen(t)
    with pytest.raises(ZeroDivisionError), t.begin() as batch:
        batch.delete(make([(1, None, None)]))
        1 / 0  # noqa: B018
    with pytest.raises(Exception, match="gone"), t.begin() as batch:
        batch.update(make([(1, "w", 1.0)]).selectExpr("id", "if(id = 1, raise_error('gone'), a) AS a"))
    assert seen(t) == before and t.begin().commit() is None
    assert t.restore(0) == 2 and seen(t) == seen(t, 0) and len(seen(t)) == 3
    total = t.stats().first()
    assert (total.commits, total.operations) == (2, 4) and total.last_at is not None
    with pytest.raises(LookupError):
        t.read(9)
    empty = SnapshotTable.create(make([]), str(tmp_path / "e"))
    assert empty.read().count() == 0 and empty.stats().first().operations == 0

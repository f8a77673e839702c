"""Registered queries against DuckDB on the smallest tables, and literal cases."""

import datetime
import math

import duckdb
import pytest

from mnemosaic.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_denoise_literals(spark):
    got = {r.q: r.reason for r in QUERIES["f1_denoise_literals"](spark, DIR).collect()}
    assert got["[HEARTBEAT] system ok"] == "heartbeat" and got["好的"] == "short"
    assert got["You are a helpful assistant"] == "system_prompt" and got["请问现在几点了，谢谢你"] == "time_query"
    assert got["用户喜欢川菜和粤菜的味道"] is None


def test_tokenizer_literals(spark):
    got = {r.q: r for r in QUERIES["x3_token_literals"](spark, DIR).collect()}
    assert set(got["用户ab"].core) == {"ab", "用户", "户"}
    assert set(got["用户名ab"].module) == {"用户", "户名", "用户名", "ab"}


def test_intent_and_expansion_literals(spark):
    intents = {r.q: (r.intent, r.confidence) for r in QUERIES["x13_x14_intent"](spark, DIR).collect()}
    assert intents["用户不喜欢吃什么"] == ("negation", 0.9) and intents["用户最近在做什么"] == ("temporal", 0.85) and intents["hangzhou 天气"] == ("fuzzy", 0.8)
    assert "杭州 天气" in {r.q: r.queries for r in QUERIES["x14_expand"](spark, DIR).collect()}["hangzhou 天气"]


def test_mmr_starts_with_the_most_relevant(spark):
    from mnemosaic.operators.search import mmr

    rows = [(1, "a b", 1, "x y"), (1, "a b", 2, "a b"), (1, "a b", 3, "a b c")]
    got = mmr(spark.createDataFrame(rows, "qid long, q string, id long, content string"), 2).orderBy("pos").collect()
    assert got[0].id == 2 and len(got) == 2


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""URL verdicts: longest-match rules, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table of URLs by plain gradient descent on the driver; its weights are
rounded to integers, so sums are exact in any order. Scoring is built of SQL functions alone.

Edge cases: a null url, or one without "://", has an empty host and path and is scored on those. Very long urls are scored
whole. Repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import needed

#: Fixed rules: verdict, host, start of the path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BUCKETS, SIZES, ROUND = 2048, (3, 4), 10_000
#: A URL is blocked where the model finds that at odds of 1.6 or more: names that it has not seen score near even odds.
MARGIN = ROUND // 2
#: The small labelled table: host words and path words of URLs to block and to allow.
BLOCKED_HOSTS = (
    "spam-farm", "cheap-pills", "casino-bonus", "free-money", "adult-cams", "win-prizes", "pills-online", "click-bait", "payday-loans", "replica-watches", "hot-singles", "crack-keygen", "seo-links", "betting-tips", "xxx-videos",
    "cash-loans", "money-prizes", "win-cash", "seo-spam", "links-farm", "bet-casino", "free-bonus", "best-pills", "cams-adult", "fast-money", "loans-online", "click-links", "poker-cash", "slots-casino", "cheap-viagra", "loans-fast", "free-prizes", "adult-chat", "keygen-serial", "watch-replica", "bonus-bet", "singles-dating",
)
ALLOWED_HOSTS = (
    "blog", "news", "docs", "library", "wiki", "museum", "university", "weather", "science", "recipes", "garden", "history", "school", "physics", "travel", "music", "gallery", "archive", "city", "forum",
    "theatre", "open-data", "river-lab", "mountain-club", "star-chart", "m.journal", "www.press", "research", "council", "kitchen",
)
#: Names without a meaning, as most hosts have: syllables put together by a rule, to allow.
SYLLABLES = ("ba", "ko", "mi", "ta", "lu", "ne", "ro", "si", "va", "du", "pe", "ga", "fo", "li", "mer", "ster", "land", "ton", "ing", "er", "al", "on")
PLAIN_HOSTS = tuple("".join(SYLLABLES[(7 * i + 5 * j * j + 3 * i * j) % len(SYLLABLES)] for j in range(2 + i % 3)) for i in range(60))
BLOCKED_PATHS = ("buy-now", "viagra", "free-download", "casino", "bonus?aff=1", "xxx")
ALLOWED_PATHS = ("en/676", "fr/25.html", "de/853/", "es/471", "about", "articles/2024")


def labelled(held: bool | None = False) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): each host word under several domains, with paths of either kind. held: the words kept for judging (each fifth), the others, or all (None)."""
    take = lambda words: [(n, w) for n, w in enumerate(words) if held is None or (n % 5 == 3) == held]
    rows = []
    for i, domain in enumerate(("example.com", "example.net", "example.org")):
        for prefix in ("", "www."):
            for n, name in take(BLOCKED_HOSTS):
                rows.append((f"{prefix}{name}.{domain}", "/" + (ALLOWED_PATHS + BLOCKED_PATHS)[(n + 5 * i) % 12], 1))
            for n, name in take(PLAIN_HOSTS):
                rows.append((f"{prefix}{name}.{domain}", "/" + ALLOWED_PATHS[(n + i) % 6], 0))
            for n, name in take(ALLOWED_HOSTS):
                rows.append((f"{prefix}{name}.{domain}", "/" + ALLOWED_PATHS[(n + i) % 6], 0))
                rows.append((f"{prefix}{name}.{domain}", "/" + BLOCKED_PATHS[(n + i) % 6], 1) if n % 5 == 0 else (f"{prefix}{name}.{domain}", "/" + ALLOWED_PATHS[(n + i + 1) % 6], 0))
    return rows


def held_out_quality() -> tuple[float, float]:
    """Share of the kept URLs to block that are blocked, and of those to allow that are allowed: hosts whose words training didn't see."""
    bias, w = weights()
    said = [(y, bias + sum(w[i] for i in buckets(f"^{h}${p}")) > MARGIN) for h, p, y in labelled(True)]
    right = lambda y: [s == bool(y) for label, s in said if label == y]
    return sum(right(1)) / len(right(1)), sum(right(0)) / len(right(0))


def buckets(text: str) -> list[int]:
    """Hashed n-grams of a text; a code point counts modulo 251."""
    c = [ord(x) % 251 for x in text]
    return [functools.reduce(lambda a, b: a * 257 + b, c[i : i + n], n) % BUCKETS for n in SIZES for i in range(len(c) - n + 1)]


@functools.cache
def weights(rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Bias and bucket weights, in units of 1 / ROUND of the log odds."""
    rows = [(buckets(f"^{h}${p}"), y) for h, p, y in labelled()]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        grad, gb = [decay * x for x in w], 0.0
        for f, y in rows:
            z = b + sum(w[i] for i in f)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) / len(rows)
            gb += miss
            for i in f:
                grad[i] += miss
        w, b = [x - rate * g for x, g in zip(w, grad)], b - rate * gb
    return round(b * ROUND), tuple(round(x * ROUND) for x in w)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substr(url, at + F.lit(3)), "^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise(F.lit(""))


def rule_match(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def log_odds(host: Column, path: Column) -> tuple[Column, Column]:
    """The codes of a URL's characters, and the model's sum over a column __codes of them, in units of 1 / ROUND."""
    bias, w = weights()
    table = F.array(*map(F.lit, w))
    text = F.concat(F.lit("^"), host, F.lit("$"), path)
    codes = F.transform(F.split(text, ""), lambda c: F.pmod(F.ascii(c), F.lit(251)))
    total = F.lit(bias)

    def adder(n: int):  # noqa: ANN202
        def add(total: Column, i: Column) -> Column:
            value = F.lit(n)
            for j in range(n):
                value = F.pmod(value * 257 + F.element_at(F.col("__codes"), i + j), F.lit(BUCKETS))
            return total + F.element_at(table, value + 1)

        return add

    for n in SIZES:
        places = F.when(F.size("__codes") >= n, F.sequence(F.lit(1), F.size("__codes") - (n - 1))).otherwise(F.array().cast("array<int>"))
        total = total + F.aggregate(places, F.lit(0), adder(n))
    return codes, total


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row. See the module for edge cases."""
    rows = needed(pages, page_id=(id_col, "long"), url=(url_col, "string"))
    rows = rows.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    name, verdict = rule_match(F.col("host"), F.col("path"))
    codes, total = log_odds(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "__ruled": verdict}).withColumn("__codes", F.when(F.col("__ruled").isNull(), codes))
    judged = F.coalesce("__ruled", F.when(total > MARGIN, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", judged.alias("verdict"))


def judge_sql() -> str:
    """The same in DuckDB's SQL."""
    bias, w = weights()
    fits = [(said, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for said, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for _, name, f in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for v, _, f in fits) + " END"
    sums = []
    for n in SIZES:
        value = str(n)
        for j in range(n):
            value = f"(({value}) * 257 + c[i + {j}]) % {BUCKETS}"
        sums.append(f"coalesce(list_sum([w[1 + {value}] for i in range(1, len(c) - {n - 2})]), 0)")
    return f"""
WITH h AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), g AS (
  SELECT *, [unicode(x) % 251 for x in string_split('^' || host || '$' || path, '')] AS c, {list(w)} AS w FROM h
)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({said}, CASE WHEN {bias} + {' + '.join(sums)} > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM g
"""

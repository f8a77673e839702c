"""Time expressions in text and the ranges they mean, as column expressions.

The longest expression at a place wins (大后天 isn't also 后天). Weeks run from Monday 00:00:00 to Sunday 23:59:59. Lunar
holidays are found but have no range, as they need a lunar calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expressions and what they add to the reference day, week, month or year.
DAYS = {"大前天": -3, "前天": -2, "昨天": -1, "今天": 0, "今日": 0, "明天": 1, "明日": 1, "后天": 2, "大后天": 3}
WEEKS = {"上上周": -2, "上上星期": -2, "上周": -1, "本周": 0, "这周": 0, "这个星期": 0, "本星期": 0, "下周": 1, "下下周": 2, "下下星期": 2}
MONTHS = {"上上个月": -2, "上个月": -1, "上月": -1, "本月": 0, "这个月": 0, "下个月": 1, "下月": 1, "下下个月": 2}
YEARS = {"前年": -2, "去年": -1, "上年": -1, "今年": 0, "本年": 0, "明年": 1, "来年": 1, "后年": 2}
HOURS = {"今早": (6, 11), "今晨": (6, 11), "早上": (6, 11), "上午": (6, 11), "中午": (11, 13), "下午": (13, 18), "午后": (13, 18), "今晚": (18, 24), "夜里": (18, 24)}
WEEKDAYS = {"周一": 0, "星期一": 0, "周二": 1, "星期二": 1, "周三": 2, "星期三": 2, "周四": 3, "星期四": 3, "周五": 4, "星期五": 4, "周末": 5, "星期六": 5, "周六": 5, "星期日": 6, "周日": 6, "星期天": 6}
MOMENTS = ("刚才", "方才", "片刻前")
LUNAR = ("正月初一", "正月十五")
DATES = ("[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日?", "[0-9]{4}年[0-9]{1,2}月", "[0-9]{4}年", "[0-9]{1,2}月[0-9]{1,2}日?")
CONNECTORS = "，。、的了在是和 就又"

WORDS = sorted([*DAYS, *WEEKS, *MONTHS, *YEARS, *HOURS, *WEEKDAYS, *MOMENTS, *LUNAR], key=lambda w: (-len(w), w))
PATTERN = "|".join([*DATES, *WORDS])


def _of(words: dict[str, int], x: Column) -> Column:
    """A word's number; null for other words."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in words.items() for v in kv)), x)


def _last_second(start: Column, next_start: Column) -> Column:
    return F.struct(start.cast("timestamp").alias("start"), (next_start.cast("timestamp") - F.expr("INTERVAL 1 SECOND")).alias("end"))


def category(x: Column) -> Column:
    return (
        F.when(x.rlike("^[0-9]"), "date").when(x.isin(*DAYS), "day").when(x.isin(*WEEKS), "week").when(x.isin(*MONTHS), "month").when(x.isin(*YEARS), "year")
        .when(x.isin(*HOURS), "part_of_day").when(x.isin(*WEEKDAYS), "weekday").when(x.isin(*MOMENTS), "moment").otherwise("lunar")
    )


def time_range(x: Column, now: Column) -> Column:
    """(start, end) of an expression as seen from now; null for what has no range, such as day 31 of a short month."""
    today = F.to_date(now)
    week, month = F.to_date(F.date_trunc("week", now)), F.to_date(F.date_trunc("month", now))
    year, hours = F.year(now), F.create_map(*(F.lit(v) for w, (a, b) in HOURS.items() for v in (w, a * 100 + b)))
    ymd = [F.try_element_at(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), F.lit(i)).cast("int") for i in (1, 2, 3)]
    date = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    span = lambda start, n: _last_second(start, F.date_add(start, n))
    months = lambda start, n: _last_second(start, F.add_months(start, n))
    full, ym, y, md = (x.rlike(f"^{p}$") for p in DATES)
    one = F.lit(1)
    ahead = F.pmod(_of(WEEKDAYS, x) - F.weekday(today), F.lit(7))
    weekday = F.date_add(today, F.when((ahead == 0) & (F.hour(now) > 12), 7).otherwise(ahead))
    part = F.element_at(hours, x)
    at = lambda h: F.timestamp_seconds(F.unix_timestamp(today.cast("timestamp")) + h * 3600)
    whole = (
        F.when(full, span(date(*ymd), 1)).when(ym, months(date(ymd[0], ymd[1], one), 1)).when(y, months(date(ymd[0], one, one), 12)).when(md, span(date(year, ymd[0], ymd[1]), 1))
        .when(x.isin(*DAYS), span(F.date_add(today, _of(DAYS, x)), 1)).when(x.isin(*WEEKS), span(F.date_add(week, _of(WEEKS, x) * 7), 7))
        .when(x.isin(*MONTHS), months(F.add_months(month, _of(MONTHS, x)), 1)).when(x.isin(*YEARS), months(date(year + _of(YEARS, x), one, one), 12))
        .when(x.isin(*WEEKDAYS), span(weekday, 1)).when(x.isin(*MOMENTS), span(today, 1))
        .when(x.isin(*HOURS), F.struct(at(F.floor(part / 100)).alias("start"), (at(part % 100) - F.when(part % 100 == 24, F.expr("INTERVAL 1 SECOND")).otherwise(F.expr("INTERVAL 0 SECOND"))).alias("end")))
    )
    return F.when(whole["start"].isNotNull(), whole)


def event_context(before: Column, after: Column) -> Column:
    """What stands near an expression: up to 10 characters of either side, without connecting words."""
    b = F.regexp_replace(before, rf"[{CONNECTORS}\s]+$", "")
    a = F.regexp_replace(after, rf"^[{CONNECTORS}\s]+", "")
    return F.array_join(F.filter(F.array(F.right(b, F.lit(10)), F.left(a, F.lit(10))), lambda v: v != ""), " ")


def time_expressions(text: Column, now: Column) -> Column:
    """array of (pos, text, category, range, event) in the order of the text; pos counts from 0."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    gaps = F.split(t, PATTERN, -1)
    # Start of each match: lengths of the gaps up to it and of the matches before it, in one pass.
    step = F.zip_with(F.transform(found, F.length), F.transform(F.slice(gaps, 1, F.size(found)), F.length), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    starts = F.aggregate(
        step, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")),
        lambda s, v: F.struct((s["end"] + v["g"] + v["m"]).alias("end"), F.array_append(s["at"], s["end"] + v["g"]).alias("at")),
    )["at"]

    def one(x: Column, pos: Column) -> Column:
        before = F.right(F.substring(t, F.lit(1), pos), F.lit(20))
        after = F.substring(t, pos + F.length(x) + 1, F.lit(20))
        return F.struct(pos.alias("pos"), x.alias("text"), category(x).alias("category"), time_range(x, now).alias("range"), event_context(before, after).alias("event"))

    return F.zip_with(found, starts, one)


def parsed_time(value: Column) -> Column:
    """A UTC timestamp out of ISO text (with a Z, an offset or neither) or milliseconds since 1970; null for other text."""
    iso = F.try_to_timestamp(F.regexp_replace(F.trim(value), "Z$", "+00:00"))
    millis = F.timestamp_millis(F.when(value.rlike("^[0-9]{11,14}$"), value.try_cast("long")))
    return F.coalesce(millis, F.when(value.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), iso))


def to_millis(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))

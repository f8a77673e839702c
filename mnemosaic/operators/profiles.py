"""Profiles of users, and advice about a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words of each category.
INTERESTS = ("喜欢", "爱好", "兴趣", "热衷", "爱")
PREFERENCES = ("偏好", "宁愿", "更愿意", "觉得", "认为")
SKILLS = ("擅长", "精通", "会", "懂", "掌握", "专业")
LOCATIONS = ("住在", "在", "位于", "城市")
WORK = ("工作", "公司", "职业", "职位", "岗位")


def snippets(content: Column, words: tuple[str, ...]) -> Column:
    """For each word that a text holds, fifty characters from where it first stands."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(content, w))
    return F.transform(found, lambda w: F.trim(F.substring(content, F.instr(content, w), F.lit(50))))


def work_of(content: Column) -> Column:
    """What stands between the first word of work that a text holds and the next comma, or that word again."""
    out = F.lit(None).cast("string")
    for word in reversed(WORK):
        out = F.when(F.contains(content, F.lit(word)), F.trim(F.element_at(F.split(F.element_at(F.split(content, word), 2), ","), 1))).otherwise(out)
    return out


def profile(memories: DataFrame, key: str = "user_id") -> DataFrame:
    """interests, preferences, skills and locations of each user out of facts and preferences, each in order and at most 20 (10 locations), and the latest work by text."""
    none = F.array().cast("array<string>")
    of = lambda kind, words: F.when(F.col("type") == kind, snippets(F.col("content"), words)).otherwise(none)
    cats = {"interests": of("fact", INTERESTS), "preferences": of("preference", PREFERENCES), "skills": of("fact", SKILLS), "locations": of("fact", LOCATIONS)}
    rows = memories.select(key, *(v.alias(k) for k, v in cats.items()), F.when(F.col("type") == "fact", work_of(F.col("content"))).alias("work"))
    # Distinct snippets first, so a user's rows are gathered only as far as the list goes.
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in cats))).alias("x")).select(key, "x.kind", F.explode("x.found").alias("s")).distinct()
    ranked = long.withColumn("n", F.row_number().over(Window.partitionBy(key, "kind").orderBy("s"))).where((F.col("n") <= 10) | ((F.col("kind") != "locations") & (F.col("n") <= 20)))
    lists = ranked.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("s")))).alias(k) for k in cats))
    work = rows.groupBy(key).agg(F.max("work").alias("work"))
    return work.join(lists, key, "left").select(key, *(F.coalesce(k, none).alias(k) for k in cats), "work")


def suggestions() -> Column:
    """Advice from the columns total, stale, orphaned, low, preferences, facts and forget_ratio of a store."""
    low = F.col("low") / F.greatest("total", F.lit(1)) > 0.3
    rules = [
        (F.col("stale") > 0, "stale"), (F.col("orphaned") > 0, "orphaned"), (low, "low"), ((F.col("preferences") < 3) & (F.col("total") > 20), "few_preferences"),
        ((F.col("facts") > 50) & (F.col("preferences") < F.col("facts") / 20), "mostly_facts"), (F.col("forget_ratio") > 0.2, "forgetting"), (F.col("forget_ratio").between(0.1000001, 0.2), "decaying"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))
    return F.when(F.col("total") == 0, F.array(F.lit("empty"))).when(F.size(found) == 0, F.array(F.lit("healthy"))).otherwise(found)

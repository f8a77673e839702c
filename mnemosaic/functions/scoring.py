"""Scores, decay curves and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000.0


def survival(days: Column, shape: float = 0.5, scale: float = 30.0) -> Column:
    """Weibull survival of a memory last used some days ago; the future counts as now."""
    return F.when(days < 0, F.lit(1.0)).otherwise(F.exp(-F.pow(F.greatest(days, F.lit(0.0)) / scale, F.lit(shape))))


def protected_decay(initial: Column, days: Column) -> Column:
    """Decay of shape 1.5 with a longer scale for important memories and a floor of .3 of the initial importance."""
    scale = F.when(initial >= 0.9, 60.0).when(initial >= 0.7, 45.0).otherwise(30.0)
    left = F.greatest(initial * F.exp(-F.pow(F.greatest(days, F.lit(0.0)) / scale, F.lit(1.5))), initial * 0.3)
    return F.when(days <= 0, initial).otherwise(left)


def boosted(decayed: Column, access: Column) -> Column:
    return F.least(F.lit(1.0), decayed * (1 + access * 0.1))


def forgetting_score(days: Column, access: Column, initial: Column) -> Column:
    raw = F.least(days / 90, F.lit(1.0)) * 0.5 + F.greatest(F.lit(0.0), 1 - access / 20.0) * 0.5 - initial * 0.2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def decay_multiplier(days: Column, current: Column, access: Column) -> Column:
    age = F.when(days < 7, 1.2).when((days > 30) & (current < 0.6), 0.8).when(days > 90, 0.5).otherwise(1.0)
    return age * F.when(access > 10, 1.1).when(access > 5, 1.05).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda x: x != ""))


def fallback_rerank(distance: Column, query: Column, content: Column) -> Column:
    """.5 similarity, .3 share of the query's words, .2 closeness to 200 characters."""
    n = F.length(content)
    fit = F.when(n < 400, 1 - F.abs(n - 200) / 400.0).otherwise(0.5)
    share = F.size(F.array_intersect(words(query), words(content))) / F.nullif(F.size(words(query)), F.lit(0))
    return (1 - distance) * 0.5 + F.coalesce(share, F.lit(0.0)) * 0.3 + fit * 0.2


def blended_rerank(distance: Column, model_score: Column, *list_keys: str) -> Column:
    """.3 similarity and .7 of a model's score, scaled to 0..1 within its list; .5 where all of a list's scores are equal."""
    w = Window.partitionBy(*list_keys)
    low, high = F.min(model_score).over(w), F.max(model_score).over(w)
    return (1 - distance) * 0.3 + F.coalesce((model_score - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.5)) * 0.7


def graph_score(centrality: Column, depth: Column) -> Column:
    return centrality * 0.1 / (1 + depth * 0.5)


def effective_k(weight: Column) -> Column:
    return 60 / (weight * 5 + 0.5)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """SHA-256 bytes over 255, padded with zeros, of length one: a stand-in without meaning for an embedding model."""
    sha = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(sha, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, v: s + v * v))
    return F.concat(F.transform(raw, lambda v: v / F.nullif(norm, F.lit(0.0))), F.array_repeat(F.lit(0.0), max(0, dims - 32)))


def tier(importance: Column) -> Column:
    return F.when(importance > 0.9, "HOT").when(importance > 0.7, "WARM").when(importance > 0.5, "COLD").otherwise("ARCHIVED")


def keep_class(importance: Column) -> Column:
    return F.when(importance > 0.5, "warm").when(importance >= 0.3, "cold").otherwise("discard")


def recall(hits: Column, relevant: Column, results: Column) -> Column:
    """Share of the relevant rows found; without any, 1 if nothing was found, else 0."""
    return F.when(relevant == 0, F.when(results == 0, 1.0).otherwise(0.0)).otherwise(hits / F.nullif(relevant, F.lit(0)))


def explored(weights: Column, share: float = 0.1, most: float = 0.05, low: float = 0.05, high: float = 0.5, seed: int = 11) -> Column:
    """An array of weights, some of them (by the share) moved a little at random, clamped and normalised."""
    draw, moves = F.rand(seed), [F.rand(seed + 1 + n) for n in range(4)]
    moved = F.array(*(F.greatest(F.lit(low), F.least(F.lit(high), weights[n] + (m * 2 - 1) * most)) for n, m in enumerate(moves)))
    total = F.aggregate(moved, F.lit(0.0), lambda a, b: a + b)
    return F.when(draw < share, F.transform(F.transform(F.arrays_zip(moved.alias("m"), F.array_repeat(total, 4).alias("t")), lambda x: x["m"] / x["t"]), lambda v: v)).otherwise(weights)


def hop_score(hop: Column) -> Column:
    """What a review gives answers over so many hops."""
    return F.when(hop == 1, 0.85).otherwise(F.greatest(F.lit(0.0), 1 - (hop - 1) * 0.15))


def hop_target(hop: Column) -> Column:
    return F.when(hop == 1, 0.9).when(hop == 2, 0.75).otherwise(0.6)

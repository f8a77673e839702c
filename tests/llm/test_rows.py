"""Rows told apart, clashing names, and operators against brute force on random rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemosaic.llm import exact_dedup, line_dedup, mixing, packing, pii, simhash_dedup, token_counts, topk_search, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use for columns of their own.
CLASHES = "row long, other_row long, __id long, __n long, __sha2 string, __words int, gone int, size string, taken int, copy int, kind int, lid string, fp string, text_ string"


def frame(spark, rows):
    """rows of (doc_id, text, source), with columns of all clashing names."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 4, "x", 5, 6, "s", 7, 8, 9, "l", "f", "t") for i, t, s in rows], schema)


def plain(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")


def jaccard(a, b):
    x, y = ({t[i : i + line_dedup.K] for i in range(max(1, len(t) - line_dedup.K + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def varied(rnd, n):
    base = ["".join(rnd.choice("abcdefgh ijklé中") for _ in range(rnd.choice((3, 12, 150, 220, 300)))) for _ in range(14)]

    def vary(x):
        x = list(x)
        for _ in range(rnd.choice((0, 1, 1))):
            x[rnd.randrange(len(x))] = rnd.choice("qrstuvw")
        return "".join(x)

    lines = lambda: [rnd.choice((vary(rnd.choice(base)), rnd.choice(base), "", "  ", "a line that is in many of the rows")) for _ in range(rnd.randrange(0, 8))]
    return [(rnd.choice((None, i, i, i // 2)), None if i % 40 == 0 else "\n".join(lines()), "s") for i in range(n)]


def kept_lines(rows, links):
    """(row, line number) of the lines that stay, by union-find over all lines."""
    places = [(i is None, i or 0, n, r, line) for r, (i, t, _) in enumerate(rows) for n, line in enumerate((t or "").split("\n")) if line.strip()]
    parent = {p[4]: p[4] for p in places}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    best = {}
    for p in places:
        best[find(p[4])] = min(best.get(find(p[4]), p[:4]), p[:4])
    return places, {(p[3], p[2]) for p in places if best[find(p[4])] == p[:4]}


@pytest.mark.parametrize("capacity", [256, 3])
def test_line_dedup_against_all_pairs(spark, capacity):
    rows = varied(random.Random(capacity), 160)
    lines = sorted({x for _, t, _ in rows for x in (t or "").split("\n") if x.strip()})
    similar = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if jaccard(a, b) >= line_dedup.SIMILARITY]
    keys = dict(zip(lines, line_dedup.band_keys([x.encode() for x in lines])))
    met = [(a, b) for a, b in similar if (keys[a] == keys[b]).any()]
    assert len(similar) > 50 and len(met) >= 0.9 * len(similar)
    places, kept = kept_lines(rows, met)
    want = Counter()
    for r, (i, _, _) in enumerate(rows):
        mine = [p[2] for p in places if p[3] == r]
        want[i, len(mine), sum((r, n) in kept for n in mine), tuple(n for n in mine if (r, n) not in kept)] += 1
    df = frame(spark, rows).coalesce(1)
    assert Counter((r.doc_id, r.n_lines, r.n_kept, tuple(r.dropped)) for r in line_dedup.dedup_lines(df, capacity=capacity).collect()) == want
    out = line_dedup.cleaned(df)
    texts = Counter((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (r, n) in kept)) for r, (i, t, _) in enumerate(rows))
    assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in out.collect()) == texts


def test_line_recall_over_the_test_documents(spark):
    """Pairs of similar lines of real documents that meet in a band, against all pairs of a sample of lines with words in common."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lines = sorted({x for t in texts for x in (t or "").split("\n") if len(x) >= 24})
    sets = [np.unique(line_dedup.shingles(x.encode())) for x in lines]
    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for h in s[:: max(1, len(s) // 60)].tolist():
            holders[h].append(n)
    near = {(a, b) for own in holders.values() for a in own[:200] for b in own[:200] if a < b and 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25}
    similar = [(a, b) for a, b in near if len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    keys = line_dedup.band_keys([x.encode() for x in lines])
    found = sum((keys[a] == keys[b]).any() for a, b in similar)
    assert len(similar) > 100 and found >= 0.9 * len(similar), (found, len(similar))


def test_sections_share_a_lines_shingles(monkeypatch):
    rnd = random.Random(2)
    line = "".join(rnd.choice("abé中𝄞 ") for _ in range(3000)).encode()
    whole, keys = line_dedup.shingles(line), line_dedup.band_keys([line])
    text = line.decode()
    assert len(whole) == len({text[i : i + line_dedup.K] for i in range(len(text) - line_dedup.K + 1)})
    monkeypatch.setattr(line_dedup, "TILE", 50)
    assert np.array_equal(whole, line_dedup.shingles(line)) and np.array_equal(keys, line_dedup.band_keys([line]))


def test_exact_keep_one_decides_by_row(spark):
    rows = [(1, "a b", "s"), (None, "ab", "s"), (None, "q", "s"), (2, "ab", "s"), (2, "c", "s"), (5, "c", "s"), (None, None, "s"), (None, " ", "s"), (9, "z", "s"), (9, "z", "s")]
    df = frame(spark, rows)
    got = exact_dedup.keep_one(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "a b"), (None, "q"), (2, "c"), (None, " "), (9, "z")])
    assert exact_dedup.keep_one(df.limit(0)).count() == 0


def test_simhash_keep_one_decides_by_row(spark):
    a, b, c, e = (" ".join(f"{w}{i}" for i in range(400)) for w in ("apple", "brick", "cloud", "eagle"))
    # Null ids: a copy of a row with an id, a text of its own, and a group of null ids alone. Id 5: a copy and a text of its own.
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, c, "s"), (None, c, "s"), (5, a, "s"), (5, e, "s"), (7, "only once", "s"), (8, None, "s")]
    df = frame(spark, rows)
    got = simhash_dedup.keep_one(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (None, b), (None, c), (5, e), (7, "only once"), (8, None)])
    assert simhash_dedup.keep_one(df.limit(0)).count() == 0


def mix_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by source: shares by weight, stopped at most times the size, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        more = {s for s in order if s not in full and target[s] >= most * sizes[s]}
        if not more or more == set(order) - full:
            return target
        full |= more


def test_mixing_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.choice((0, 1, 7, 50))), rnd.choice(("a", "a", "a", "b", "c", "é", None))) for i in range(300)]
    rows += [(None, "w w w", "a")] * 100 + [(4, "x y", "b")] * 60 + [(5, None, "b"), (6, "", None)]
    df = plain(spark, rows).repartition(5)
    got = mixing.mix(df, slices=8).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = mix_targets(sizes)
    assert len(got) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(plain(spark, rows[::-1]).repartition(3), slices=8).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source is None, r.source, r.size, r.taken)
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_mixed_meets_targets_with_repeated_rows(spark):
    rows = [(None, "one two three", "a")] * 100 + [(i, "four five six seven eight", "b") for i in range(60)]
    df = frame(spark, rows)
    want = mix_targets({"a": 300, "b": 300})
    out = mixing.mixed(df)
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r.__getitem__("__words") == 5 and r.size == "s"
    assert out.columns == df.columns and all(abs(words[s] - want[s]) <= 1 for s in want)
    assert mixing.mixed(df.limit(0)).count() == 0


def top_brute(rows, k=5):
    ok = [(i, [topk_search.whole(x, 256) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q and len(c) == len(v))[:k]
            want += [(q, n, i, min(max(-s, topk_search.LEAST), topk_search.MOST)) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


LARGE = [(50, [1e12, 2.0]), (1, [1e12, 1.0]), (2, [3.0, 1.0]), (3, [1e300, -1e300]), (100, [1.7e308, 1.7e308]), (4, [1e12, 1.0]), (150, [-1e308, 5.0]), (5, [1e12, 1.001]), (0, [1.0, 1.0]), (0, [2.0, -1.0]), (7, [1e-320, -1e-320]), (8, [-1.7e308, -1.6e308]), (200, [1.0]), (9, [2.0]), (250, [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("blocks, queries", [(64, 512), (2, 3)])
def test_topk_of_any_finite_vectors(spark, monkeypatch, blocks, queries):
    monkeypatch.setattr(topk_search, "CHUNK_BLOCKS", blocks)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", queries)
    rng = random.Random(1)
    for rows in (LARGE, [(50 * i, [float(2**26 + i), float(i)]) for i in range(6)] + [(50 * i + 1, [float(2**26 - i), 0.5]) for i in range(9)], [(i, [rng.choice((0.0, 0.25, 1.0)) for _ in range(3)]) for i in range(260)], [], [(50, [1.0])], [(1, [1.0])]):
        got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert sorted(map(tuple, got.collect())) == top_brute(rows)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(d if n % 2 == 0 else 2 * d - 9 * (d > 4) for n, d in enumerate(map(int, digits[::-1])))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if valid(k, m.group())] for k, p in BASE.items()}


def test_pii_base_against_brute_force(spark):
    rnd = random.Random(12)
    parts = ["a@b.co", "@", ".", "%", "x-y", "1.2.3.4", "300.1", "0001", "4111 1111 1111 1111", "4111-1111", "11", "+1 (555) 123-4567", "+", "(", ")", "-", " ", "é", "𝄞", "\n", "tel ", "555-123-4567", "joe at site dot com", "\x01", "\x02", "2024"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice((1, 4, 12, 60)))) for _ in range(500)] + [None, "", "1.2.3.4 " * 900, "4111 1111 1111 1111 x " * 300, "555-123-4567 " * 700, "a@b.co,c" * 400, "9" * 5000]
    got = {r.doc_id: r for r in pii.find_pii(plain(spark, [(n, t, "s") for n, t in enumerate(texts)]).repartition(8)).collect()}
    assert len(got) == len(texts)
    for n, t in enumerate(texts):
        want, r = base_spans(t or ""), got[n]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in BASE for s, e in want[k]).encode()).hexdigest()
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == ([len(want[k]) for k in BASE], digest), repr(t)
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        base = {(k, s, e) for k in BASE for s, e in want[k]}
        assert base <= set(spans) and len(spans) == len(base) + r.n_added
        added = sorted(set(spans) - base, key=lambda x: x[1:])
        assert all(e <= s2 for (_, _, e), (_, s2, _) in zip(added, added[1:])), "added spans overlap"
        ends = sorted((s, e) for _, s, e in base)
        assert not any(s < e2 and s2 < e for _, s, e in added for s2, e2 in ends), "an added span overlaps a base span"


def test_pii_of_dense_texts_in_tiles_equals_pairwise(spark, monkeypatch):
    texts = ["call 555-123-4567 and tel 5551234567, " * 40, "555 123 4567 890 123 4567 " * 60, "1.2.3.4 mail joe at site dot com " * 50]
    df = plain(spark, [(n, t, "s") for n, t in enumerate(texts)])
    tiled = sorted((r.doc_id, r.spans) for r in pii.find_pii(df).collect())
    monkeypatch.setattr(pii, "TILE", 1 << 20)
    assert tiled == sorted((r.doc_id, r.spans) for r in pii.find_pii(df).collect()) and all(x for _, x in tiled)


def test_packing_ties_and_null_ids(spark):
    rows = [(None, "w " * 300, "s")] * 30 + [(1, "w " * 300, "s")] * 20 + [(2, None, "s"), (2, "", "s"), (3, "w " * 9000, "s")]
    got = packing.best_fit(plain(spark, rows), shard_pieces=16).collect()
    assert Counter((r.doc_id, r.length) for r in got if r.doc_id != 3) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows if i != 3)
    assert sum(r.length for r in got if r.doc_id == 3) == 9000
    again = packing.best_fit(plain(spark, rows), shard_pieces=16).collect()
    assert Counter((r.doc_id, r.piece, r.offset, r.capacity) for r in got) == Counter((r.doc_id, r.piece, r.offset, r.capacity) for r in again)
    lengths = [300] * 50 + [0, 0, 4096]
    bins, offsets, sizes = packing.pack(lengths)
    fill = Counter()
    for b, n in zip(bins, lengths):
        fill[b] += n
    assert all(sizes[b] == min(c for c in packing.LENGTHS if c >= fill[b]) for b in fill)


def test_empty_tables_and_null_ids(spark):
    import public_tokenizers

    none = frame(spark, [(1, "a", "s")]).limit(0)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, host int, __codes int")).count() == 0
    assert token_counts.token_counts(none, path).count() == 0 and pii.find_pii(none).count() == 0 and packing.best_fit(none).count() == 0
    assert line_dedup.cleaned(none).count() == 0
    rows = [(None, "good day", "s"), (None, "good day", "s"), (3, None, "s")]
    model = toxicity.train([b"good day friend", b"bad vile thing"] * 20, [0, 1] * 20, ["en"] * 40, [i % 5 == 4 for i in range(40)], epochs=2)
    got = toxicity.scores(frame(spark, rows), model).collect()
    assert len(got) == 3 and [r.held_out for r in got if r.doc_id is None] == [False, False] and all(r.score is not None for r in got)
    assert toxicity.scores(none, model).count() == 0
    assert sorted(r.n_tokens for r in token_counts.token_counts(frame(spark, rows), path).collect())[0] == 0


def test_toxicity_slices_give_the_score_of_one_slice(monkeypatch):
    rnd = random.Random(1)
    model = toxicity.train([b"good day friend", b"bad vile thing"] * 20, [0, 1] * 20, ["en"] * 40, [i % 5 == 4 for i in range(40)], epochs=2)
    words = " ".join(rnd.choice(("the", "vile", "bad", "thing", "zürich", "中文", "good")) for _ in range(3000))
    texts = [words.encode(), b"x" * 3000, b"", b"vile  bad", b"a " * 900, b"   ".join([b"bad", b"vile", b"thing"] * 400), b",".join([b"bad", b"vile"] * 900), "中".encode() * 4000, b" " * 999, b"bad" + b" " * 700 + b"vile", b"y" * 130 + b" bad " + b"z" * 64]
    whole = toxicity.score_texts(model, texts)
    for size in (1, 7, 64, 200, 4096):
        monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
        assert np.allclose(whole, toxicity.score_texts(model, texts), atol=1e-6)

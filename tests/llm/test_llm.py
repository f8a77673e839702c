"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from mnemosaic.llm import exact_dedup, line_dedup, mixing, packing, pii, shared, simhash_dedup, token_counts, topk_search, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, entry string"
WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, ["en", None, "fr"][n % 3], [None, "b", "a"][n % 3], None, n, "x") for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


RND = random.Random(3)
LONG = " ".join(RND.choice(("the", "on", "thing", "zürich", "中文", "a")) for _ in range(30_000))
TEXTS = [None, "", " \n\t", "One two three four five", "one  two three\tfour five", "onetwothreefourfive", LONG, LONG + " ", "x" * 5000, "x" * 5000, "é y", "mail a@b.co +1 555 123 4567", "4111 1111 1111 1111 at 10.0.0.1"] * 2


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, TEXTS), depth=1, max_depth=4, capacity=1).collect()
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i))
    assert len(got) == len(TEXTS)
    for r in got:
        norm = WHITE.sub("", TEXTS[r.doc_id] or "")
        keep = min(groups[norm])[1]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[norm]), keep == r.doc_id, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup_repeats_and_empty(spark):
    got = exact_dedup.exact_dedup(docs(spark, ["a b", "ab", "a b", "q"], [7, None, 7, None])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()) == [(False, 7, 3, False), (False, 7, 3, True), (True, 7, 3, False)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.keep_one(docs(spark, ["a b", "ab", "a b", "q"], [7, 8, 7, 9])).count() == 2


def test_directory_doubles():
    depth, slots = exact_dedup.directory({0: 5, 1: 1, 7: 1}, 0, 3, 2)
    assert depth == 3 and len(slots) == 8 and slots[0] != slots[1] and len(set(slots[4:])) == 1


def test_simhash(spark):
    near = [f"{LONG} {x}" for x in ("alpha", "beta", "alpha")]
    texts = [*TEXTS, *near]
    got = {r.doc_id: r for r in simhash_dedup.simhash_components(docs(spark, texts)).collect()}
    from xxhash import xxh64_intdigest

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    fps = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        h = [xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(texts))]
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(texts))}
    assert simhash_dedup.simhash_components(docs(spark, [])).count() == 0


def test_simhash_links_with_split_blocks(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for _ in range(300)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in shared.components(simhash_dedup.links(df, capacity=16)).collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        new = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= 4) for f in fps}
        changed, label = new != label, new
    assert {f: roots.get(f, f) for f in fps} == label
    # Every pair of a cell goes through the pivot table, and none that is linked is discarded.
    for capacity in (2048, 16):
        seen = simhash_dedup.pair_figures(df, capacity=capacity).first()
        near = {(f, g) for f in fps for g in fps if f < g and (f ^ g).bit_count() <= 4}
        assert seen.met == seen.discarded + seen.verified and seen.discarded > 0 and seen.verified >= seen.linked >= len(near)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 501 + i) for i in range(60)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == y for x, y in label.items())


@pytest.mark.parametrize("lane", [32, 256])
def test_token_counts(spark, monkeypatch, lane):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    alphabet = " ab e▁\n\tthé中𝄞ñ0<s>/xy  ing"
    texts = ["".join(RND.choice(alphabet) for _ in range(RND.choice((0, 1, 3, 40, 700)))) for _ in range(400)] + ["<s>", " " * 999, "th" * 2000]
    monkeypatch.setattr(token_counts, "LANE", lane)
    monkeypatch.setattr(token_counts, "TILE", 3000)
    assert token_counts.Counter(path).counts(texts) == [len(x) for x in sp.encode(texts)]
    got = token_counts.token_counts(docs(spark, TEXTS), path).collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in sorted(got, key=lambda r: r.doc_id)] == [(len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for t in TEXTS]


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice((0, 1, 5, 50))), "en", rnd.choice(("a", "a", "a", "b", "c", None)), None, 0, "") for i in range(300)]
    rows += [(1000, " ".join(["w"] * 3), "en", "tiny", None, 0, ""), (1000, " ".join(["w"] * 3), "en", "tiny", None, 0, "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), slices=8).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s] + 1e-9 for s in size)
    assert target["tiny"] == 18
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA), slices=8).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted((r.doc_id, r.size, r.taken) for r in again)
    words = sum(len(WORD.findall(r.text)) for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert abs(words - sum(taken.values())) <= 3
    assert mixing.mix(docs(spark, [])).count() == 0


def test_packing(spark):
    got = packing.best_fit(docs(spark, TEXTS + ["w " * 9001]), shard_pieces=7).collect()
    words, bins = defaultdict(int), defaultdict(list)
    for r in got:
        words[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    assert dict(words) == {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS + ["w " * 9001])}
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at == rows[0].bin_used <= rows[0].capacity and rows[0].capacity == min(c for c in packing.LENGTHS if c >= at)
    assert packing.best_fit(docs(spark, [])).count() == 0


def test_toxicity(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(("th", "er", "on", "an", "re", "ed")) for _ in range(rnd.randint(1, 3)))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            w[rnd.randrange(60)], w[rnd.randrange(60)] = "vileword", "badword"
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    df = docs(spark, [*texts, None, "", LONG * 12 + " vileword badword"])
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), sample_rows=200)
    got = toxicity.scores(df, model).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.without_toxic(df, model).columns == df.columns
    empty = toxicity.learn(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(docs(spark, ["a"]), empty).first().score == 0


def test_long_text_scores_as_in_one_slice(monkeypatch):
    model = toxicity.train([b"good day friend", b"bad vile thing"] * 20, [0, 1] * 20, ["en"] * 40, [i % 5 == 4 for i in range(40)], epochs=2)
    texts = [LONG.encode(), b"x" * 300, b"", b"vile  bad"]
    whole = toxicity.score_texts(model, texts)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 200)
    assert np.allclose(whole, toxicity.score_texts(model, texts), atol=1e-5)


def test_url_filter(spark):
    urls = [None, "no scheme", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/2", "http://a.example.net/es/1", "http://spam-farm.example.org/x", "http://thering.example.org/en/1", "http://", "http://h?x/en/", "http://notexample.com/en/1"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (2, 3, 4, 9)] == [("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("a.example.net", "/es/1", "net/es/", "block"), ("notexample.com", "/en/1", "com/", "allow")]
    assert got[5].verdict == "block" and got[6].verdict == "allow" and got[5].rule is None
    assert (got[0].host, got[1].path, got[8].host, got[8].path) == ("", "", "h", "")


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(60)]
    rows += [(300, None), (350, [float("nan")] * 8), (400, [1.0, None] * 4), (None, [1.0] * 8), (450, [1.0, 2.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and not any(x is None or x != x for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ c), i) for i, c in ok if i != q and len(c) == len(v))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and runs through the green forest until night falls over it"
    texts = [f"{line}\nshort\n\n", f"other line here\n{line.replace('green', 'greem')}", None, "", "short\nshort", LONG, f"{LONG}\nzz"]
    got = {r.doc_id: list(r.dropped) for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: [], 1: [1], 2: [], 3: [], 4: [0, 1], 5: [], 6: [0]}  # a row for each document, those without lines too
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert [r.text for r in line_dedup.cleaned(docs(spark, texts)).orderBy("doc_id").collect()][:3] == [f"{line}\nshort\n\n", "other line here", None]


def test_pii(spark):
    texts = [*TEXTS, "a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4", "+1 (555) 123-4567) +12", "phone 555-123-4567 or joe (at) site.com"]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, texts)).collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, t in enumerate(texts):
        spans = [f"email:{m.start()}:{m.end()}" for m in email.finditer(t or "")]
        assert got[i].n_email == len(spans) and set(spans) <= set(got[i].spans.split(","))
    n = len(TEXTS)
    assert [got[n + 1].n_ip, got[n + 2].n_phone, got[12].n_card, got[12].n_ip] == [3, 1, 1, 1]
    assert got[n + 3].n_added == 2 and got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()

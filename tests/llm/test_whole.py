"""Cases that were found wrong once: near copies by row, a text's own score, and proposals from every start."""

def test_toxicity_of_a_text_is_its_own():
    import numpy as np

    from mnemosaic.llm import toxicity

    rng = np.random.default_rng(1)
    model = toxicity.train([b"good day friend", b"bad vile thing"] * 20, [0, 1] * 20, ["en"] * 40, [i % 5 == 4 for i in range(40)], epochs=2)
    model.filters = [rng.normal(0, 1, f.shape).astype(np.float32) for f in model.filters]
    model.tables = [np.vstack([rng.normal(0, 1, t[:-1].shape), t[-1:]]).astype(np.float32) for t in model.tables]
    texts = [b"good day", b"", b"bad vile thing", b"a", b"good friend of mine", b"vile"]
    alone = [toxicity.score_texts(model, [t])[0] for t in texts]
    for order in (range(6), range(5, -1, -1), (1, 2, 0, 2, 3, 2, 1, 5, 4)):
        assert np.allclose(toxicity.score_texts(model, [texts[i] for i in order]), [alone[i] for i in order], atol=1e-6)


def test_toxicity_learns_from_a_text_alone(monkeypatch):
    """Training with more padding between texts gives the same model."""
    import numpy as np

    from mnemosaic.llm import toxicity

    texts = [f"{w} day{i}".encode() for i in range(20) for w in ("good", "vile")]
    args = texts, [0, 1] * 20, ["en"] * 40, [i % 5 == 4 for i in range(40)]
    padded = toxicity._padded

    def far(lots):  # noqa: ANN001, ANN202
        b1, b2, starts = padded(lots)
        more = np.full(4, toxicity.PAD, np.int32)
        parts = [(np.concatenate([b[s:e], more]), e - s + 4) for b in (b1, b2) for s, e in zip(starts[:-1], starts[1:])]
        half = len(parts) // 2
        return np.concatenate([p for p, _ in parts[:half]]), np.concatenate([p for p, _ in parts[half:]]), np.concatenate([[0], np.cumsum([n for _, n in parts[:half]])])

    near = toxicity.train(*args, epochs=2, least_steps=5)
    monkeypatch.setattr(toxicity, "_padded", far)
    apart = toxicity.train(*args, epochs=2, least_steps=5)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(near.filters + near.tables, apart.filters + apart.tables))


def test_pii_proposes_from_every_start(spark):
    """in 2024 ...: the digits pass as a card, so it is a base span, and those stay."""
    from mnemosaic.llm import pii

    want = {
        "call 12 2024 555-123-4567 now": "555-123-4567", "in 2023 555-123-4567": "555-123-4567", "in 2024 555-123-4567": "2024 555-123-4567", "555-123-4567 12": "555-123-4567", "mail joe at site dot com": "joe at site dot com",
        "write to joe at site dot com please": "joe at site dot com", "joe (AT) site.com": "joe (AT) site.com", "tel 5551234567": "5551234567", "é𝄞 phone 5551234567 and tel 5559876543": "5551234567,5559876543",
        "order 5551234567": "", "we met at noon dot now": "", "phone 555-123-4567 or joe (at) site.com": "joe (at) site.com,555-123-4567",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    texts = list(want)
    got = {texts[r.doc_id]: ",".join(texts[r.doc_id][int(s) : int(e)] for x in r.spans.split(",") if x for _, s, e in [x.split(":")]) for r in pii.find_pii(df).collect()}
    assert got == want

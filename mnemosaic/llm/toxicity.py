"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased) get two hashed embeddings from tables of their own, so
a chance collision in one table is not enough to look like a toxic word. Filters of widths 1, 2 and 3 run over
the words; each filter's maximum over the whole text goes through a rectifier and a linear layer; Platt scaling, fitted on
rows that training didn't see, makes the score a probability. Thresholds are calibrated by language on those rows; the score
itself sees the text alone.

Training takes a bounded sample (`sample_rows` of each class, in the order of a hash of doc_id, among labelled rows with
at most `sample_chars` characters); everything else covers all rows and whole texts. Without labelled rows of both
classes the model gives every text the score 0.

Edge cases: null and empty texts have a score too, that of no words. Null doc_ids are never in the training sample. Repeated
rows stay. A very long text is scored in slices that share words and hashes of divided words, so its score is that of one slice. A null doc_id
is held out of nothing (held_out is false). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import needed

BUCKET_BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
SLICE_BYTES = 1 << 16
LEAK = 0.1
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
PAD = 1 << BUCKET_BITS
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _word_sums(raw: np.ndarray, length: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Start and sum of each word of raw, and the length of the word that its end cuts, if any. length: bytes that the first word already has."""
    inside = IS_WORD[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64), 0
    at = np.arange(len(raw), dtype=np.int32)
    at[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(raw))).astype(np.int32)
    first = 0
    if length and inside[0]:
        first = int(starts[1]) if len(starts) > 1 else len(raw)
        at[:first] += length & 63
    value = (LOWER[raw] + np.uint64(1)) * POWERS[at & 63]
    value[~inside] = 0
    tail = 0
    if inside[-1]:
        tail = len(raw) - int(starts[-1]) + (length if len(starts) == 1 and starts[0] == 0 else 0)
    return starts, np.add.reduceat(value, starts), tail


def _buckets_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of words with these sums."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    return (h & mask).astype(np.int32), ((h >> np.uint64(32)) & mask).astype(np.int32)


def word_buckets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start offset and the two buckets of each word."""
    starts, sums, _ = _word_sums(np.frombuffer(data, np.uint8))
    return starts, *_buckets_of(sums)


def leaky(x: np.ndarray) -> np.ndarray:
    """A rectifier with a small slope below zero, so no filter stops learning for good."""
    return np.maximum(x, LEAK * x)


@dataclass
class Model:
    """Parameters; small and of a fixed size, so they travel with the tasks."""

    tables: list[np.ndarray]  # two of (buckets + 1, DIM); the last row, of padding, is zero
    filters: list[np.ndarray]  # by width: (width, 2 * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    c: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)
    default_threshold: float = 0.3
    empty: bool = False

    def maps(self, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
        """Each filter's value at each word, as if padding came after the last. At padding it is 0, so a text doesn't see the next one's words."""
        e = np.concatenate([self.tables[0][b1], self.tables[1][b2]], axis=1)
        n = len(e)
        found = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            a = found[:, k * FILTERS : (k + 1) * FILTERS]
            np.matmul(e, f[0], out=a)
            for j in range(1, min(w, n)):
                a[: n - j] += e[j:] @ f[j]
        found[b1 == PAD] = 0
        return found

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return leaky(pooled + self.bias) @ self.out + self.c

    def score(self, logits: np.ndarray) -> np.ndarray:
        return np.zeros(len(logits)) if self.empty else 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def _padded(lots: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' buckets end to end, two words of padding after each; and the starts."""
    pad = np.full(2, PAD, np.int32)
    b1, b2 = (np.concatenate([x for lot in lots for x in (lot[i], pad)]) for i in (0, 1))
    return b1, b2, np.concatenate([[0], np.cumsum([len(lot[0]) + 2 for lot in lots])])


def _in_slices(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Buckets of a long text's words, some SLICE_BYTES of text at a time, and whether they are the last.

    Each lot begins with the two last words of the lot before it, and a word that a cut divides goes on in the next lot
    with the hash it has so far, so the windows of all lots together are those of the whole text.
    """
    reach = max(WIDTHS) - 1
    kept = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
    begun, length = np.uint64(0), 0  # of the word that the cut divides: its sum so far, and its bytes
    for at in range(0, len(text), SLICE_BYTES):
        final = at + SLICE_BYTES >= len(text)
        raw = np.frombuffer(text, np.uint8, min(SLICE_BYTES, len(text) - at), at)
        starts, sums, tail = _word_sums(raw, length)
        if length and len(sums) and starts[0] == 0:
            sums[:1] += begun
        elif length:
            sums = np.concatenate([[begun], sums])
        begun, length = np.uint64(0), 0
        if tail and not final:
            begun, length, sums = sums[-1], tail, sums[:-1]
        now = [np.concatenate([k, b]) for k, b in zip(kept, _buckets_of(sums))]
        if final:
            now = [np.concatenate([b, np.full(reach, PAD, np.int32)]) for b in now]
        yield now[0], now[1], final
        kept = [b[-reach:] for b in now]


def _pooled_long(model: Model, text: bytes) -> np.ndarray:
    reach = max(WIDTHS) - 1
    best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
    for b1, b2, final in _in_slices(text):
        if len(b1) > reach:
            maps = model.maps(b1, b2)
            best = np.maximum(best, maps.max(0) if final else maps[:-reach].max(0))
        elif final:
            best = np.maximum(best, model.maps(b1, b2).max(0))
    return best


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts; some SLICE_BYTES of text are held as numbers at a time."""
    pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    lot: list[int] = []
    size = 0

    def settle() -> None:
        nonlocal lot, size
        if lot:
            starts, b1, b2 = word_buckets(b"\n".join(texts[i] for i in lot))
            cuts = np.searchsorted(starts, np.cumsum([len(texts[i]) + 1 for i in lot])[:-1])
            x, y, at = _padded(list(zip(np.split(b1, cuts), np.split(b2, cuts))))
            pooled[lot] = np.maximum.reduceat(model.maps(x, y), at[:-1], axis=0)
        lot, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > SLICE_BYTES:
            pooled[i] = _pooled_long(model, text)
            continue
        if size + len(text) > SLICE_BYTES:
            settle()
        lot.append(i)
        size += len(text) + 1
    settle()
    return model.score(model.logit(pooled))


def train(texts: list[bytes], labels: list[int], langs: list[str | None], held: list[bool], epochs: int = 8, batch: int = 32, rate: float = 0.05, least_steps: int = 400, seed: int = 5, odds: float | None = None) -> Model:
    """held rows calibrate the scale and the thresholds; the others train the network by Adagrad."""
    rng = np.random.default_rng(seed)
    tables = [np.vstack([rng.normal(0, 0.02, (PAD, DIM)), np.zeros((1, DIM))]).astype(np.float32) for _ in range(2)]
    n = len(WIDTHS) * FILTERS
    filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, 2 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(tables, filters, np.zeros(n, np.float32), rng.uniform(0.2, 0.6, n).astype(np.float32) * np.where(np.arange(n) % 4 == 3, -1, 1).astype(np.float32), -1.0)
    y = np.array(labels, np.float32)
    fit = np.flatnonzero(~np.array(held, bool))
    if not len(fit) or len(set(y[fit])) < 2:
        model.empty = True
        return model
    words = [word_buckets(t)[1:] for t in texts]
    memory: dict[str, np.ndarray] = {}

    def adagrad(name: str, param: np.ndarray, grad: np.ndarray) -> None:
        g = memory.setdefault(name, np.full_like(param, 1e-3))
        g += grad * grad
        param -= rate * grad / np.sqrt(g)

    squares = [np.full(PAD + 1, 1e-3, np.float32) for _ in range(2)]
    for _ in range(max(epochs, min(60, -(-least_steps * batch // len(fit))))):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            b1, b2, starts = _padded([words[i] for i in docs])
            maps = model.maps(b1, b2)
            best = np.array([starts[i] + maps[starts[i] : starts[i + 1]].argmax(0) for i in range(len(docs))])
            pooled = maps[best, np.arange(n)]
            hidden = leaky(pooled + model.bias)
            miss = (1 / (1 + np.exp(-np.clip(hidden @ model.out + model.c, -30, 30))) - y[docs]) / len(docs)
            back = miss[:, None] * model.out[None, :] * np.where(hidden > 0, 1, LEAK)
            grad_filters, rows, grads = [], [], []
            last = len(b1) - 1
            for k, w in enumerate(WIDTHS):
                part, where = back[:, k * FILTERS : (k + 1) * FILTERS], best[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(model.filters[k])
                for j in range(w):
                    pos = np.where(b1[where] == PAD, where, np.minimum(where + j, last))
                    e = np.concatenate([tables[0][b1[pos]], tables[1][b2[pos]]], axis=2)  # (docs, FILTERS, 2 * DIM)
                    g[j] = np.einsum("df,dfe->ef", part, e)
                    rows.append(pos.ravel())
                    grads.append((part[:, :, None] * model.filters[k][j].T[None]).reshape(-1, 2 * DIM))
                grad_filters.append(g)
            adagrad("out", model.out, hidden.T @ miss + 1e-4 * model.out)
            adagrad("bias", model.bias, back.sum(0))
            c = np.array([model.c])
            adagrad("c", c, np.array([miss.sum()]))
            model.c = float(c[0])
            for k, g in enumerate(grad_filters):
                adagrad(f"f{k}", model.filters[k], g)
            pos, grad = np.concatenate(rows), np.concatenate(grads).astype(np.float32)
            for table, buckets, square, half in ((tables[0], b1, squares[0], grad[:, :DIM]), (tables[1], b2, squares[1], grad[:, DIM:])):
                touched, inverse = np.unique(buckets[pos], return_inverse=True)
                total = np.zeros((len(touched), DIM), np.float32)
                np.add.at(total, inverse, half)
                square[touched] += (total * total).mean(1)
                table[touched] -= rate * total / np.sqrt(square[touched])[:, None]
                table[PAD] = 0
    calibrate(model, texts, y, langs, np.array(held, bool), odds)
    return model


def calibrate(model: Model, texts: list[bytes], y: np.ndarray, langs: list[str | None], held: np.ndarray, odds: float | None = None) -> None:
    """Platt scaling, then for each language the threshold of the best F1 (ties: nearest to the default), on held rows.

    odds: of label 1 among all labelled rows; the sample has its own, so clean rows weigh as much more as there are more of them.
    """
    at = np.flatnonzero(held)
    if not len(at) or len(set(y[at])) < 2:
        return
    p = np.clip(score_texts(model, [texts[i] for i in at]), 1e-9, 1 - 1e-9)
    z = np.log(p / (1 - p))
    good, bad = y[at].sum(), (1 - y[at]).sum()
    ratio = (good / bad) / odds if odds else 1.0
    goal = np.where(y[at] > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum((q - goal) * z) + 1e-3 * (a - 1), np.sum(q - goal)]))
        a, b = a - step[0] * 0.5, b - step[1] * 0.5
    if a > 0 and np.isfinite(a + b):
        model.scale, model.shift = float(a), float(b - np.log(ratio))
    q = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -40, 40)))
    lang = np.array([str(langs[i]) for i in at])
    for name in set(lang):
        mine = lang == name
        if y[at][mine].sum() < 5:
            continue
        tried = []
        for t in np.linspace(0.1, 0.9, 81):
            said = q[mine] >= t
            hit = (said & (y[at][mine] > 0)).sum()
            tried.append((-2 * hit / max(1, hit + ratio * (said.sum() - hit) + y[at][mine].sum()), abs(t - model.default_threshold), float(t)))
        model.thresholds[name] = min(tried)[2]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 is held out of learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2500, sample_chars: int = 20_000) -> Model:
    """A model from a bounded sample of labelled rows, none of them held out."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = marked.where(fold(F.col("id")) != 2).distinct()
    rank = F.xxhash64(F.lit(3), "id")
    # A candidate list of bounded size for each class: TakeOrdered, no shuffle of the rest.
    picked = [marked.where(F.col("y") == y).orderBy(rank, "id").limit(sample_rows) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = needed(docs, id=(id_col, "long"), text=(text_col, "string"), lang=(lang_col, "string")).where(F.length("text") <= sample_chars)
    found = sorted((r.id, r.y, r.lang or "", r.text) for r in rows.join(ids, "id").select("id", "y", "lang", "text").collect())
    held = [i % 5 == 4 for i in range(len(found))]
    n = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    return train([r[3].encode() for r in found], [r[1] for r in found], [r[2] for r in found], held, odds=n[1] / n[0] if len(n) == 2 else None)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), threshold (of the row's language) and rejected (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = score_texts(shared.value, [t.as_py() or b"" for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.float64())], names=["doc_id", "lang", "score"])

    rows = needed(docs, doc_id=(id_col, "long"), text=(text_col, "string"), lang=(lang_col, "string"))
    scored = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").mapInArrow(run, "doc_id long, lang string, score double")
    limit = F.lit(model.default_threshold)
    for name, t in sorted(model.thresholds.items()):
        limit = F.when(F.coalesce(F.col("lang"), F.lit("")) == name, F.lit(t)).otherwise(limit)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).alias("rejected"))


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows the model rejects. The verdict is made in the scan, row by row, so no row is joined or moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(text, lang):  # noqa: ANN001, ANN202
        import pandas as pd

        m = shared.value
        limits = np.array([m.thresholds.get(x or "", m.default_threshold) for x in lang])
        return pd.Series(score_texts(m, [(t or "").encode() for t in text]) >= limits)

    return docs.where(~rejected(F.col(text_col).cast("string"), F.col(lang_col).cast("string")))

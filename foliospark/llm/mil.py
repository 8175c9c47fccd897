"""Quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage of the whole text is
encoded; a gated attention (tanh times sigmoid) weighs the encodings, and the weighted mean is
scored. Encoder, attention and score are learned together by gradient descent from the labels of a
bounded sample of documents; scoring runs over all documents in their own tasks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import remainder, slices, whole_row

PASSAGE = 400          # bytes
SAMPLE = 3000          # labelled documents the model is fitted on, chosen by a hash of the id
STEP_PASSAGES = 20_000 # passages whose gradients are taken at once; a longer document is taken alone
PAIR_BUCKETS = 256
HIDDEN, GATE, EPOCHS, BATCH = 32, 16, 40, 128
REJECT_BELOW = 0.7

_CLASSES = 72


def _classes() -> np.ndarray:
    """Letters by themselves, capitals and digits as one class each, other ASCII by itself, then bytes
    above ASCII by their low bits."""
    table = np.zeros(256, np.int64)
    spare = iter(range(28, 64))
    other: dict[int, int] = {}
    for b in range(256):
        if 0x61 <= b <= 0x7A:
            table[b] = b - 0x61
        elif 0x41 <= b <= 0x5A:
            table[b] = 26
        elif 0x30 <= b <= 0x39:
            table[b] = 27
        elif b >= 0x80:
            table[b] = 64 + (b & 7)
        else:
            other[b] = table[b] = next(spare) if b >= 0x20 or b == 0x0A else 63
    return table


_TABLE = _classes()
FEATURES = _CLASSES + PAIR_BUCKETS + 3


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text of each; an empty text is one empty passage."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    parts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), parts)
    total = int(parts.sum())
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    first = np.r_[0, np.cumsum(parts)[:-1]]
    inside = np.arange(len(data)) - np.repeat(starts, sizes)
    passage = np.repeat(first, sizes) + inside // PASSAGE
    kinds = _TABLE[data]
    single = np.bincount(passage * _CLASSES + kinds, minlength=total * _CLASSES).reshape(total, _CLASSES)
    length = np.maximum(1, single.sum(1, keepdims=True))
    same = passage[1:] == passage[:-1] if len(data) else np.zeros(0, bool)
    code = (kinds[:-1] * 73 + kinds[1:]) * 40503 >> 4 & (PAIR_BUCKETS - 1)
    pairs = np.bincount(passage[:-1][same] * PAIR_BUCKETS + code[same],
                        minlength=total * PAIR_BUCKETS).reshape(total, PAIR_BUCKETS)
    share, pair_share = single / length, pairs / length
    x = np.empty((total, FEATURES), np.float32)
    x[:, :_CLASSES] = np.sqrt(share)
    x[:, _CLASSES:-3] = np.sqrt(pair_share)
    x[:, -3] = (share ** 2).sum(1)
    x[:, -2] = (pair_share ** 2).sum(1)
    x[:, -1] = single.sum(1) / PASSAGE
    return x, owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights: encoder W, attention V, U, w, score c."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = weights, mean, scale
        self.fitted = False  # whether both labels were there to learn from

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * s) @ p["w"]
        top = np.full(bags, -np.inf, raw.dtype)
        np.maximum.at(top, owner, raw)
        e = np.exp(raw - top[owner])
        a = e / np.bincount(owner, e, bags)[owner]
        z = np.zeros((bags, h.shape[1]), h.dtype)
        np.add.at(z, owner, a[:, None].astype(h.dtype) * h)
        return {"h": h, "t": t, "s": s, "a": a.astype(h.dtype), "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, owner = encode(texts)
        return self.forward((x - self.mean) / self.scale, owner, len(texts))["y"].astype(float)

    def gradients(self, x, owner, labels) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, owner, len(labels))
        h, t, s, a, z = (f[k] for k in "htsaz")
        d = ((f["y"] - labels) / len(labels)).astype(h.dtype)
        dz = d[:, None] * p["c"]
        dh = a[:, None] * dz[owner]
        da = (h * dz[owner]).sum(1)
        draw = a * (da - np.bincount(owner, a * da, len(labels))[owner].astype(h.dtype))
        gate = draw[:, None] * p["w"]
        dv, du = gate * s * (1 - t * t), gate * t * s * (1 - s)
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du,
                "w": (t * s).T @ draw, "c": z.T @ d, "c0": d.sum(keepdims=True)}


def _spread(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the features over all passages, one bag at a time."""
    n, total, squares = 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for b in bags:
        b = b.astype(np.float64)
        n, total, squares = n + len(b), total + b.sum(0), squares + (b * b).sum(0)
    mean = total / max(1, n)
    spread = np.sqrt(np.maximum(0, squares / max(1, n) - mean * mean))
    return mean.astype(np.float32), (spread + 1e-2).astype(np.float32)


def _groups(chosen: np.ndarray, bags: list[np.ndarray]) -> list[np.ndarray]:
    """The chosen bags in order, in groups of about ``STEP_PASSAGES`` passages; every bag whole."""
    out, size = [], STEP_PASSAGES
    for i in chosen:
        if size + len(bags[i]) > STEP_PASSAGES:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(bags[i])
    return [np.array(g) for g in out if g]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Model:
    """Adam over batches of bags; the same sample gives the same model. Without both labels the
    score is the share of label 1 (one half without any)."""
    rng = np.random.default_rng(seed)
    mean, scale = _spread(bags)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE),
         "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": np.zeros(HIDDEN, np.float32),
         "c0": np.array([np.log(share / (1 - share))], np.float32)}
    model = Model(p, mean, scale)
    if len(set(labels.tolist())) < 2:
        return model
    model.fitted = True
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            for part in _groups(chosen, bags):
                x = (np.concatenate([bags[i] for i in part]).astype(np.float32) - mean) / scale
                owner = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
                for k, v in model.gradients(x, owner, labels[part].astype(np.float32)).items():
                    g[k] += v * np.float32(len(part) / len(chosen))
            step += 1
            for k in p:
                grad = g[k] + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] -= (3e-3 * (first[k] / (1 - 0.9 ** step))
                         / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows whose crc32(doc_id) mod 4 is not 2.

    The sample is the rows of smallest hash, so it is spread over all sources; only encoded passages
    of it reach the driver, all of each row, in a file there.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                           & (remainder(F.col("doc_id"), 4) != 2))
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(29))
    chosen = usable.orderBy(order, "doc_id").limit(sample)  # bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "quality", "text")

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "text", 2_000_000):
                x, owner = encode(part["text"].tolist())
                out = []
                for i in range(len(part)):
                    own = slice(*np.searchsorted(owner, [i, i + 1]))  # every passage
                    out.append(x[own].astype(np.float16).tobytes())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "quality": part["quality"].to_numpy(), "x": out})

    got = (rows.mapInPandas(passages, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary")
           .orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id", "x").limit(sample))
    sizes, marks = [], []
    with tempfile.TemporaryFile() as file:
        for r in got.toLocalIterator():
            file.write(r.x)
            sizes.append(len(r.x) // (2 * FEATURES))
            marks.append(r.quality)
        file.flush()
        flat = np.memmap(file, np.float16, "r", shape=(sum(sizes), FEATURES)) if sizes else np.zeros((0, FEATURES))
        bags = np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []
        return fit(bags, np.array(marks))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``quality_score`` (replaced if there is one); null texts are empty."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"text": texts.to_numpy()})
        parts = [shared.value.score(part["text"].tolist()) for part in slices(frame, "text", 2_000_000)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("quality_score", score(F.coalesce("text", F.lit(""))))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row; empty texts are scored too.

    Repeated rows get equal scores, an empty table gives no rows; without labels every score is 0.5.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
                      F.col("quality_score").alias("score"),
                      F.when(F.col("quality_score") >= REJECT_BELOW, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged.

    Without usable rows of both labels there is nothing to reject by, and all rows stay.
    """
    model = train(docs, labels)
    if not model.fitted:
        return docs
    rows = docs.select(whole_row(docs), "text")
    return scored(rows, model).filter(F.col("quality_score") >= REJECT_BELOW).select("_row.*")

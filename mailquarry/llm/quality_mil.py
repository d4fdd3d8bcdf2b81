"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.bytetext import SPACED, pieces, text_buffer, words
from mailquarry.llm.sampling import fold
from mailquarry.llm.storage import bounded_batches, documents, trimmed
from mailquarry.llm.toxic_segments import labelled_sample

#: Labelled documents for each class, and the characters that are learned from in a longer text.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 12_000
#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 400
HIDDEN, ATTENTION, EPOCHS, RATE, SEED = 24, 12, 250, 0.02, 11

_CLASSES = 9


def _class_of(b: int) -> int:
    if b == 10 or b == 13:
        return 1
    if b == 32 or b == 9:
        return 0
    c = chr(b)
    if b >= 128:
        return 2
    if c.islower():
        return 3
    if c.isupper():
        return 4
    if c.isdigit():
        return 5
    if c in ".,;:'\"-()":
        return 6
    return 7 if b > 32 else 8


_CLASS = np.array([_class_of(b) for b in range(256)], np.int64)
WIDTH = _CLASSES * _CLASSES + 6


def encode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text).

    Shares of the pairs of neighbouring character classes; share of words that
    occurred before in the passage, of words equal to the one before, and of
    words that occur elsewhere in the text; mean word length; passage length;
    length of the text. An empty text has one passage of zeros.
    """
    size = np.diff(offs)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.r_[0, np.cumsum(count)]
    out = np.zeros((first[-1], WIDTH), np.float32)
    if not len(data):
        return out, first
    doc = np.repeat(np.arange(len(size)), size)
    passage = first[doc] + (np.arange(len(data)) - offs[doc]) // PASSAGE
    kind = _CLASS[data]
    pair = passage[1:] * (_CLASSES * _CLASSES) + kind[:-1] * _CLASSES + kind[1:]
    pair = pair[passage[1:] == passage[:-1]]
    shares = np.bincount(pair, minlength=len(out) * _CLASSES * _CLASSES).reshape(len(out), -1)
    length = np.bincount(passage, minlength=len(out))
    out[:, : _CLASSES * _CLASSES] = np.sqrt(shares / np.maximum(length, 1)[:, None])
    digest, starts, woffs = words(data, offs, SPACED)
    h = digest[:, 0]
    if len(h):
        of, wdoc = passage[starts], np.repeat(np.arange(len(size)), np.diff(woffs))
        n = np.maximum(np.bincount(of, minlength=len(out)), 1)
        order = np.lexsort((starts, h, wdoc))
        hs, ds, ps = h[order], wdoc[order], of[order]
        same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
        again = np.bincount(ps[1:][same & (ps[1:] == ps[:-1])], minlength=len(out))
        shared = np.zeros(len(h), bool)
        shared[1:] |= same
        shared[:-1] |= same
        anywhere = np.bincount(ps[shared], minlength=len(out))
        twin = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=len(out))
        base = _CLASSES * _CLASSES
        out[:, base] = again / n
        out[:, base + 1] = twin / n
        out[:, base + 2] = anywhere / n
        out[:, base + 3] = np.log1p(length / n) / 3
    out[:, -2] = np.minimum(length, PASSAGE) / PASSAGE
    out[:, -1] = np.log1p(np.repeat(size, count)) / 10
    return out, first


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    c0: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["a"]
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[of])
    weight = e / np.add.reduceat(e, first[:-1])[of]
    bag = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
    return h, t, g, of, weight, bag, _sigmoid(bag @ p["c"] + p["c0"])


def gradient(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, bag_weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss of the bags, by each parameter."""
    h, t, g, of, weight, bag, prob = _forward(p, x, first)
    d = bag_weight * (prob - y)
    grad = {"c": bag.T @ d, "c0": np.array([d.sum()])}
    d_bag = d[:, None] * p["c"]
    along = (d_bag[of] * h).sum(1)
    d_e = weight * (along - np.add.reduceat(weight * along, first[:-1])[of])
    grad["a"] = (t * g).T @ d_e
    d_t, d_g = d_e[:, None] * p["a"] * g * (1 - t * t), d_e[:, None] * p["a"] * t * g * (1 - g)
    grad["v"], grad["u"] = h.T @ d_t, h.T @ d_g
    d_h = (weight[:, None] * d_bag[of] + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - h * h)
    grad["w"], grad["b"] = x.T @ d_h, d_h.sum(0)
    return grad


def fit(texts: list[str], labels: list[int], base: float | None = None) -> MilModel:
    """Learn the passage encoder and the gated attention from document labels alone (Adam, full batch)."""
    raw = [t.encode() for t in texts] or [b""]
    y = np.array(labels or [1], float)
    offs = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    parts = [encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in pieces(offs)]
    x = np.concatenate([f for f, _ in parts]).astype(np.float64)
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))]
    mean, scale = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / scale
    rng = np.random.RandomState(SEED)
    p = {
        "w": rng.randn(WIDTH, HIDDEN) / np.sqrt(WIDTH),
        "b": np.zeros(HIDDEN),
        "v": rng.randn(HIDDEN, ATTENTION) / np.sqrt(HIDDEN),
        "u": rng.randn(HIDDEN, ATTENTION) / np.sqrt(HIDDEN),
        "a": rng.randn(ATTENTION) / np.sqrt(ATTENTION),
        "c": rng.randn(HIDDEN) / np.sqrt(HIDDEN),
        "c0": np.zeros(1),
    }
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = share if base is None else min(max(base, 1e-6), 1 - 1e-6)
    bag_weight = np.where(y == 1, base / share, (1 - base) / (1 - share)) / len(y)
    m = {k: np.zeros_like(z) for k, z in p.items()}
    s = {k: np.zeros_like(z) for k, z in p.items()}
    for step in range(1, EPOCHS + 1):
        grad = gradient(p, x, first, y, bag_weight)
        for k in p:
            q = grad[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * q
            s[k] = 0.999 * s[k] + 0.001 * q * q
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, p["w"], p["b"], p["v"], p["u"], p["a"], p["c"], float(p["c0"][0]))


def score(model: MilModel, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, passage with the largest attention, that attention) of every text."""
    x, first = encode(data, offs)
    p = {k: getattr(model, k) for k in ("w", "b", "v", "u", "a", "c", "c0")}
    *_, of, weight, _, prob = _forward(p, (x - model.mean) / model.scale, first)
    top = np.maximum.reduceat(weight, first[:-1])
    at = np.flatnonzero(weight == top[of])
    at = at[np.r_[True, of[at][1:] != of[at][:-1]]]
    return prob, at - first[:-1], top


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> MilModel:
    return fit(*labelled_sample(docs, labels, "quality", per_class, max_chars))


def score_documents(docs: DataFrame, model: MilModel) -> DataFrame:
    """(doc_id, score, top_passage, top_weight) for every whole text.

    A null or empty text counts as one passage of zeros and so has a score of
    its own. ``top_passage`` is the number of the passage that the attention
    weights most, the first among equals. Every row gives one row, also with a
    null or repeated doc_id. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            got = [score(shared.value, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in pieces(offs)]
            columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.float64()), pa.array(columns[1].astype(np.int64)), pa.array(columns[2], pa.float64())], names=["doc_id", "score", "top_passage", "top_weight"])
            trimmed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, top_passage long, top_weight double")


def op7_attention(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; remainder 0 of crc32(doc_id) mod 5 is held out of training."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "top_passage", "top_weight")

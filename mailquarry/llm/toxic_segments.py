"""Toxic passages by maximum-scoring segments over token log-odds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.llm.bytetext import LETTERED, pieces, text_buffer, word_prefixes, words
from mailquarry.llm.sampling import bounded_sample, fold, piece_of
from mailquarry.llm.storage import bounded_batches, documents, trimmed

#: Labelled documents for each class, and the characters that are learned from in a longer text.
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 12_000
#: A token counts as evidence by the lower bound of its log-odds: this many standard errors down, less a margin.
CAUTION, MARGIN = 3.0, 0.1
#: Score of a word that training did not see often enough.
UNKNOWN = -0.25
MIN_COUNT = 4
#: A word stands for itself and for its beginnings of these lengths, in bytes; its best evidence counts.
PREFIXES = (4, 5)
#: Expected number of as good segments by chance, up to which a segment is significant.
SIGNIFICANT = 0.05
#: Bounds of the extreme-value constants; they hold where clean texts show no segment at all.
RATE_MOST, LOG_K_LEAST = 3.0, -8.0
_EULER = 0.5772156649015329


@dataclass
class ToxicModel:
    """Token scores (by sorted word hash), extreme-value constants and calibration."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float
    log_k: float
    weights: np.ndarray


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by one left-to-right scan.

    Each candidate keeps the running sum before it (low) and after it (high).
    A new positive token looks back for the last candidate with a lower low;
    it is merged with that one if its own high is larger, else it stands alone.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    found: list[list] = []
    back: list[int] = []
    for i in np.flatnonzero(score > 0):
        own = [int(i), int(i) + 1, float(total[i]), float(total[i + 1])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = back[j]
            if j < 0 or found[j][3] >= own[3]:
                found.append(own)
                back.append(j)
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:], back[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def log_odds(toxic: np.ndarray, clean: np.ndarray, caution: float = CAUTION) -> np.ndarray:
    """Cautious log-odds of each word from its counts in both classes, under a Dirichlet prior.

    The prior spreads one pseudo-count for each word by the pooled frequencies.
    """
    both = toxic + clean
    prior = len(both) * both / max(both.sum(), 1)
    a0 = prior.sum()
    x, y = toxic + prior, clean + prior
    delta = np.log(x / np.maximum(toxic.sum() + a0 - x, 1e-9)) - np.log(y / np.maximum(clean.sum() + a0 - y, 1e-9))
    return delta - caution * np.sqrt(1 / x + 1 / y) - MARGIN


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Numbers of every word and of its beginnings, starts, word offsets by text."""
    h, starts, woffs = words(data, offs, LETTERED)
    return [h[:, 0], *(word_prefixes(data, offs, starts, LETTERED, k) for k in PREFIXES)], starts, woffs


def _scored(model: ToxicModel, tokens: list[np.ndarray]) -> np.ndarray:
    best = np.full(len(tokens[0]), -np.inf)
    for h in tokens if len(model.hashes) else []:
        at = np.searchsorted(model.hashes, h)
        at[at == len(model.hashes)] = 0
        np.maximum(best, np.where(model.hashes[at] == h, model.scores[at], -np.inf), out=best)
    return np.where(np.isinf(best), UNKNOWN, best)


def _found(model: ToxicModel, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, float, float]]]:
    """Per text the segments as (first byte, first byte of the last word, score, log expected number)."""
    tokens, starts, woffs = _tokens(data, offs)
    s = _scored(model, tokens)
    out: list[list[tuple[int, int, float, float]]] = [[] for _ in range(len(offs) - 1)]
    hot = np.unique(np.searchsorted(woffs, np.flatnonzero(s > 0), "right") - 1)
    for d in hot:
        a, b = woffs[d], woffs[d + 1]
        for i, j, x in segments(s[a:b]):
            chance = model.log_k + np.log(b - a) - model.rate * x
            out[d].append((int(starts[a + i] - offs[d]), int(starts[a + j - 1] - offs[d]), float(x), float(chance)))
    return out


def _features(found: list[list[tuple[int, int, float, float]]]) -> np.ndarray:
    """Evidence of the best segment, and of all of them together, on a log scale."""
    best = [max((-c for *_, c in f), default=0.0) for f in found]
    every = [sum(max(0.0, -c) for *_, c in f) for f in found]
    return np.stack([np.ones(len(found)), np.log1p(np.maximum(best, 0)), np.log1p(every)], 1)


def _probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))


def fit(texts: list[str], labels: list[int], base: float | None = None) -> ToxicModel:
    """Token scores from word counts, a Gumbel law from the clean texts, then a logistic calibration.

    ``base`` is the share of toxic documents among all labelled ones, where the
    sample has another.
    """
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    y = np.array(labels)
    parts, by, scored_words = [], [], []
    for i, j in pieces(offs):
        tokens, _, woffs = _tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        of = np.repeat(np.arange(i, j), np.diff(woffs))
        for h in tokens:  # a token counts once for each text
            order = np.lexsort((of, h))
            first = np.ones(len(h), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
            parts.append(h[order][first])
            by.append(y[of[order][first]])
        scored_words.append((tokens, y[of]))
    h, of = np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, int), *by])
    hashes, at = np.unique(h, return_inverse=True)
    toxic = np.bincount(at, weights=of == 1, minlength=len(hashes))
    clean = np.bincount(at, weights=of == 0, minlength=len(hashes))
    often = toxic + clean >= MIN_COUNT
    hashes, scores = hashes[often], np.clip(log_odds(toxic, clean), -1.0, 8.0)[often]
    rate, model = RATE_MOST, ToxicModel(hashes, scores, 1.0, 0.0, np.zeros(3))
    drawn = np.concatenate([np.zeros(0), *(_scored(model, t)[label == 0] for t, label in scored_words)])
    if (drawn > 0).any() and (drawn < 0).any():
        low, high = 1e-6, 50.0  # the positive root of E exp(rate * score) = 1 over clean words
        for _ in range(60):
            rate = (low + high) / 2
            low, high = (low, rate) if np.exp(np.minimum(rate * drawn, 700)).mean() > 1 else (rate, high)
    model.rate = rate = min(max(rate, 0.05), RATE_MOST)
    found = [f for i, j in pieces(offs) for f in _found(model, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
    quiet = [max((-c for *_, c in f), default=np.nan) for f, label in zip(found, y, strict=True) if label == 0]
    quiet = [x for x in quiet if not np.isnan(x)]
    share = len(quiet) / max((y == 0).sum(), 1)
    # -log E of the best clean segment is Gumbel with mean -log K + 0.577; clean texts without a segment thin K out
    model.log_k = float(np.clip(np.mean(quiet) - _EULER + np.log(max(share, 1e-3)), LOG_K_LEAST, 3)) if quiet else LOG_K_LEAST
    found = [[(a, b, s, c + model.log_k) for a, b, s, c in f] for f in found]
    x = _features(found)
    share = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, (base or share) / max(share, 1e-9), (1 - (base or share)) / max(1 - share, 1e-9))
    w = np.zeros(3)
    for _ in range(50):
        p = _probability(w, x)
        r = weight * p * (1 - p) + 1e-9
        w = w + np.linalg.solve(x.T @ (x * r[:, None]) + 1e-2 * np.eye(3), x.T @ (weight * (y - p)) - 1e-2 * w)
    model.weights = w
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, max_chars: int) -> tuple[list[str], list[int], float | None]:
    """(texts, labels, share of ones among all labels): at most per_class texts of either label.

    The ids are drawn from the labels alone, so only a bounded list is
    broadcast to the documents; a document labelled both ways counts as 1. Of
    a text longer than max_chars a piece of that length is learned from.
    """
    one = labels.where(F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    base = one.agg(F.avg("_y")).first()[0]
    ids = bounded_sample(one, "_y", "doc_id", per_class)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("text", piece_of("text", "doc_id", max_chars))
    texts, ys = [], []
    for r in sorted(rows.select("doc_id", "text", "_y").collect(), key=lambda r: (r.doc_id, r.text)):
        texts.append(r.text)
        ys.append(int(r._y))
    return texts, ys, base


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> ToxicModel:
    texts, ys, base = labelled_sample(docs, labels, "toxic", per_class, max_chars)
    return fit(texts, ys, base)


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_segments", T.LongType()),
        T.StructField("log_expected", T.DoubleType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("log_expected", T.DoubleType())]))),
    ]
)


def score_documents(docs: DataFrame, model: ToxicModel, significant: float = SIGNIFICANT) -> DataFrame:
    """(doc_id, score, n_segments, log_expected, segments) for every whole text.

    ``segments`` has the significant passages as byte positions of their first
    and last word; ``log_expected`` is that of the best one, null without any
    positive word. A null or empty text has no segment and the lowest score.
    Every row gives one row, also with a null or repeated doc_id; columns other
    than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    limit = float(np.log(significant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            found = [f for i, j in pieces(offs) for f in _found(m, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
            score = _probability(m.weights, _features(found)) if found else np.zeros(0)
            kept = [[dict(zip(("start", "last_word", "score", "log_expected"), x, strict=True)) for x in f if x[3] <= limit] for f in found]
            best = [min((c for *_, c in f), default=None) for f in found]
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array([len(k) for k in kept], pa.int64()), pa.array(best, pa.float64())]
            columns.append(pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("log_expected", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=_OUT.names)
            trimmed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def op8_segments(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; remainder 2 of crc32(doc_id) mod 4 is held out of training."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_segments", "log_expected")

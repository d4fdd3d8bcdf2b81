"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.bytetext import pieces, text_buffer
from mailquarry.llm.sampling import bounded_sample, fold, piece_of
from mailquarry.llm.storage import bounded_batches, documents, trimmed

#: Training documents for each language, and the characters that are learned from in a longer text.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 4_000
#: Languages that are learned, those with the most documents first.
LANGUAGES = 400
#: Bytes of a model; where the sample gives a larger one, half as many documents are learned from.
MODEL_BYTES = 200 << 20
#: Bytes of the longest context.
ORDER = 3
#: Code lengths that are held at once.
CELLS = 1 << 20
UNDETERMINED = "und"


@dataclass
class Contexts:
    """The contexts of one length, for all languages: a row of the tree's nodes at that depth.

    ``known`` has the contexts and ``escape`` what it costs each language to
    leave them; ``pair`` has every byte that followed one (context * 256 +
    symbol) and ``bits`` its whole code length in each language.
    """

    known: np.ndarray
    escape: np.ndarray
    pair: np.ndarray
    bits: np.ndarray


@dataclass
class PpmModel:
    """Frozen statistics of all languages: context trees by depth, every context that was seen.

    ``symbol`` maps a byte to its code (0: never seen in training); ``bits0``
    has the code lengths without a context, ``levels`` the contexts of one
    byte, two bytes and so on.
    """

    languages: list[str]
    symbol: np.ndarray
    bits0: np.ndarray
    levels: list[Contexts]

    @property
    def nbytes(self) -> int:
        return self.bits0.nbytes + sum(x.nbytes for level in self.levels for x in vars(level).values())


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 capitals in UTF-8."""
    out = data.copy()
    capital = (data >= 65) & (data <= 90)
    out[capital] += 32
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


def _contexts(code: np.ndarray, offs: np.ndarray, order: int) -> list[np.ndarray]:
    """The 1, 2, ... codes before each byte, as numbers of eight bits a code; 0 before a text's start."""
    starts, ends = offs[:-1], offs[1:]
    out, acc = [], np.zeros(len(code), np.uint64)
    for k in range(1, order + 1):
        c = np.zeros(len(code), np.uint64)
        c[k:] = code[:-k] if k < len(code) else c[k:]
        for j in range(k):
            at = starts + j
            c[at[at < ends]] = 0
        acc = acc | (c << np.uint64(8 * (k - 1)))
        out.append(acc)
    return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each wanted key, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _lengths(bits0: np.ndarray, levels: list[Contexts], ctx: list[np.ndarray], code: np.ndarray) -> np.ndarray:
    """Code length of each byte in each language: in its longest known context, or after the escapes from there."""
    out = np.zeros((len(code), bits0.shape[1]), np.float32)
    open_ = np.arange(len(code))
    for k in range(len(levels), 0, -1):
        if not len(open_):
            return out
        level, here = levels[k - 1], ctx[k - 1][open_]
        at, hit = _found(level.pair, (here << np.uint64(8) | code[open_]).astype(level.pair.dtype))
        out[open_[hit]] += level.bits[at[hit]]
        open_, here = open_[~hit], here[~hit]
        at, hit = _found(level.known, here.astype(level.known.dtype))
        out[open_[hit]] += level.escape[at[hit]]
    out[open_] += bits0[code[open_].astype(np.int64)]
    return out


def fit(samples: dict[str, list[str]], order: int = ORDER) -> PpmModel:
    """Count every context of up to ``order`` (7 at most) bytes for each language and freeze the code lengths.

    A seen byte costs -log2(n / (T + D)), an unseen one first pays the escape
    -log2(D / (T + D)) and is then coded in the context that is one byte
    shorter, down to 8 bits for any byte; n is its count, T the context's
    total and D its number of different bytes.
    """
    languages = sorted(samples)
    texts = {x: [t.encode() for t in samples[x]] for x in languages}
    raw = {x: folded(np.frombuffer(b"".join(texts[x]), np.uint8)) for x in languages}
    seen = np.zeros(256, bool)
    for x in languages:
        seen[raw[x]] = True
    symbol = np.zeros(256, np.uint8)
    symbol[seen] = np.arange(1, seen.sum() + 1)  # UTF-8 has 243 different bytes
    many = len(languages)
    bits0 = np.full((256, many), 8.0, np.float32)
    keys: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for k, x in enumerate(languages):
        code = symbol[raw[x]].astype(np.uint64)
        n = np.bincount(code.astype(np.int64), minlength=256).astype(float)
        if n.sum():
            whole, different = n.sum() + (n > 0).sum(), (n > 0).sum()
            bits0[:, k] = np.where(n > 0, -np.log2(np.maximum(n, 1) / whole), 8 - np.log2(different / whole))
        ctx = _contexts(code, np.r_[0, np.cumsum([len(t) for t in texts[x]])].astype(np.int64), order)
        for d in range(order):
            keys[d].append(np.unique(ctx[d] << np.uint64(8) | code, return_counts=True))
    levels: list[Contexts] = []
    for d in range(order):
        kind = np.uint32 if d < 3 else np.uint64
        pair = np.unique(np.concatenate([p for p, _ in keys[d]] or [np.zeros(0, np.uint64)]))
        known, of = np.unique(pair >> np.uint64(8), return_inverse=True)
        escape = np.zeros((len(known), many), np.float32)
        # without an own count: the escape, if the language has the context, and then the shorter context
        lower = [known_k[of] for known_k in ([known & np.uint64((1 << 8 * k) - 1) for k in range(1, d + 1)])]
        bits = _lengths(bits0, levels, lower, pair & np.uint64(255))
        for k, (own, n) in enumerate(keys[d]):
            at = np.searchsorted(pair, own)
            total = np.bincount(of[at], weights=n, minlength=len(known))
            different = np.bincount(of[at], minlength=len(known))
            whole = total + different
            escape[:, k] = np.where(total > 0, -np.log2(np.maximum(different, 1) / np.maximum(whole, 1)), 0)
            bits[:, k] += escape[of, k]
            bits[at, k] = -np.log2(n / whole[of[at]])
        levels.append(Contexts(known.astype(kind), escape, pair.astype(kind), bits))
    return PpmModel(languages, symbol, bits0, levels)


def code_lengths(model: PpmModel, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Exact code length in bits of every text under every language."""
    out = np.zeros((len(offs) - 1, len(model.languages)))
    if not len(data):
        return out
    code = model.symbol[folded(data)].astype(np.uint64)
    ctx = _contexts(code, offs, len(model.levels))
    step = max(4096, CELLS // len(model.languages))
    for a in range(0, len(code), step):
        b = min(a + step, len(code))
        each = _lengths(model.bits0, model.levels, [c[a:b] for c in ctx], code[a:b])
        first = np.unique(np.maximum(offs[np.searchsorted(offs, a, "right") - 1 : np.searchsorted(offs, b)], a))
        out[np.searchsorted(offs, first, "right") - 1] += np.add.reduceat(each, first - a, axis=0, dtype=np.float64)
    return out


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> PpmModel | None:
    """Fit on a bounded sample of the rows with a language; None if there are none.

    Of a text longer than ``max_chars`` a piece of that length is learned from.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    most = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    ids = bounded_sample(rows.where(F.col("lang").isin(most)), "lang", "doc_id", per_language)
    samples: dict[str, list[str]] = {}
    found = docs.select("doc_id", piece_of("text", "doc_id", max_chars).alias("text")).join(F.broadcast(ids), "doc_id").collect()
    for r in sorted(found, key=lambda r: (r.lang, r.doc_id, r.text or "")):
        samples.setdefault(r.lang, []).append(r.text or "")
    if not samples:
        return None
    model = fit(samples)
    while model.nbytes > MODEL_BYTES and max(map(len, samples.values())) > 1:
        samples = {x: t[: -(-len(t) // 2)] for x, t in samples.items()}
        model = fit(samples)
    return model


def lettered(text: Column) -> Column:
    """Whether a text has a letter; a null one has none."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: PpmModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for every document.

    The prediction is the language with the shortest code for the whole text,
    the first by name among equals; the score is its posterior probability
    under equal priors. A null, empty or letterless text is ``und`` with
    score 0, and so is every text if no language was learned. Every row gives
    one row, also with a null or repeated doc_id. Columns other than doc_id and
    text are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered(F.col("text")).alias("lettered"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            names: list[str] = [UNDETERMINED] * n
            score, rate = np.zeros(n), np.zeros(n)
            if m is not None and n:
                ok = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
                data, offs = text_buffer(batch.column(2))
                for i, j in pieces(offs, 1 << 18):
                    own = offs[i : j + 1] - offs[i]
                    bits = code_lengths(m, data[offs[i] : offs[j]], own)
                    best = bits.argmin(1)
                    least = bits[np.arange(j - i), best]
                    post = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    score[i:j] = np.where(ok[i:j], post, 0.0)
                    rate[i:j] = least / np.maximum(np.diff(own), 1)
                    names[i:j] = [m.languages[b] if o else UNDETERMINED for b, o in zip(best, ok[i:j], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])
            trimmed()

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def op10_ppm(spark, sf_dir: str) -> DataFrame:
    """Language of every document; remainder 2 of crc32(doc_id) mod 4 is held out of training."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")

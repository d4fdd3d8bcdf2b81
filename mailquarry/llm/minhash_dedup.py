"""MinHash near-duplicate detection with b-bit signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.llm.bytetext import SPACED, distinct_pairs, distinct_shingles, mix, pieces, text_buffer
from mailquarry.llm.components import connected_components
from mailquarry.llm.storage import bounded_batches, documents, settled, stored, trimmed

#: 16 bands of 4 minima: a pair at similarity 0.85 shares no band with chance 8e-6, at 0.8 with 2e-4.
BANDS, ROWS = 16, 4
#: Low bits kept of each minimum.
BITS = 4
#: Minima of the longer signature that candidate documents get.
LONG = 512
#: Ids of candidate documents that are broadcast; beyond it their texts are joined by shuffle.
BROADCAST_IDS = 1_000_000

_K = BANDS * ROWS
_rng = np.random.RandomState(20240917)
_MULT = _rng.randint(0, 2**63, _K + LONG, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.randint(0, 2**63, _K + LONG, dtype=np.int64).astype(np.uint64)

_SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("fingerprint", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("bits", T.ArrayType(T.LongType())),
    ]
)


def minima(sets: list[np.ndarray], functions: range = range(_K)) -> np.ndarray:
    """The minimum of every set under each of the hash functions; sets are not empty. The first lane is hashed."""
    all_, at = np.concatenate([s[:, 0] for s in sets]), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), len(functions)), np.uint64)
    with np.errstate(over="ignore"):
        for i, k in enumerate(functions):
            out[:, i] = np.minimum.reduceat(all_ * _MULT[k] + _PLUS[k], at)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    grouped = mins.reshape(len(mins), BANDS, ROWS)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT[0], (len(mins), BANDS)).copy()
        for r in range(ROWS):
            acc = mix(acc * _MULT[1] + grouped[:, :, r])
    return acc.view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """The low BITS bits of each mixed minimum, packed into 64-bit words."""
    with np.errstate(over="ignore"):
        low = mix(mins.copy()) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    low = low.reshape(len(mins), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=2).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        sets: list[np.ndarray] = []
        for i, j in pieces(offs):
            sets += distinct_shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words, SPACED)
        prints: list[bytes | None] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        some = [k for k, s in enumerate(sets) if len(s)]
        keys: list[np.ndarray | None] = [None] * len(sets)
        bits: list[np.ndarray | None] = [None] * len(sets)
        for a in range(0, len(some), 512):
            part = some[a : a + 512]
            m = minima([sets[k] for k in part])
            for k, x, y in zip(part, band_keys(m), packed_bits(m), strict=True):
                keys[k], bits[k] = x, y
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            names=_SKETCH.names,
        )
        trimmed()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Set size, set fingerprint, band keys and b-bit signature of each document."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _sketch(it, words), _SKETCH)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        out: list[bytes] = []
        sizes: list[int] = []
        bits: list[np.ndarray] = []
        for i, j in pieces(offs):
            sets = distinct_shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words, SPACED)
            for a in range(0, len(sets), 512):
                bits += list(packed_bits(minima(sets[a : a + 512], range(_K, _K + LONG))))
            out += [s.tobytes() for s in sets]
            sizes += [len(s) for s in sets]
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(out, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "long_bits", "shingles"])
        trimmed()


def estimated_similarity(a: Column, b: Column, hashes: int = _K) -> Column:
    """Jaccard similarity from the share of equal b-bit minima, corrected for chance collisions."""
    ones = F.lit(int("1" * (64 // BITS), 1 << BITS)) if BITS > 1 else F.lit(-1)
    unequal = F.lit(0)
    for w in range(hashes * BITS // 64):
        x = a[w].bitwiseXOR(b[w])
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unequal = unequal + F.bit_count(folded.bitwiseAND(ones))
    chance = 1 / (1 << BITS)
    return (1 - unequal / F.lit(float(hashes)) - chance) / (1 - chance)


def screen(similarity: float, hashes: int = _K, deviations: float = 6.5) -> float:
    """The estimate below which a pair of that similarity falls only with a negligible chance."""
    p = similarity + (1 - similarity) / (1 << BITS)
    lowest = p - deviations * (p * (1 - p) / hashes) ** 0.5
    return (lowest - 1 / (1 << BITS)) / (1 - 1 / (1 << BITS))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sizes of the full sets and of their intersection."""
    for batch in batches:
        a, b, x, y = (batch.column(k) for k in range(4))
        nu, nv, common = [], [], []
        for k in range(batch.num_rows):
            p, q = (np.frombuffer(z[k].as_buffer(), np.uint64).reshape(-1, 2) for z in (x, y))
            nu.append(len(p))
            nv.append(len(q))
            common.append(len(p) + len(q) - len(distinct_pairs(np.concatenate([p, q]))))
        yield pa.RecordBatch.from_arrays([a, b, *(pa.array(c, pa.int64()) for c in (nu, nv, common))], names=["u", "v", "nu", "nv", "common"])


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by shingle-set similarity num/den or more.

    ``docs`` needs doc_id and text; other columns are not looked at. Each row
    is a document of its own, so rows that repeat a doc_id have a row each and
    the smallest doc_id is kept in all of them. Words are lowered runs of
    non-space bytes; they and the shingles are told apart by 128-bit digests. A text with fewer words than a
    shingle is one shingle; a null, empty or blank text has the empty set and
    links with nothing. Ties go to the smallest doc_id. An empty table gives an
    empty result. Rows with a null doc_id are ignored.

    1. One pass makes for every document the set fingerprint, the band keys
       and the b-bit signature. Equal sets become one class (a partial
       aggregate, so a group of copies is never gathered).
    2. In each band bucket every class is compared with the bucket's smallest
       only: one row per member. Signatures screen, full sets confirm.
    3. Buckets that still hold several components get the rest of the
       comparisons: members outside the bucket's largest component against all
       members of other components. Links inside a component are not needed.
       A pair is met in its first common bucket only. The symmetric difference
       of two sets is at least the difference of their symmetric differences
       from the bucket's smallest, which rules out most pairs exactly; a
       signature of LONG minima screens the rest; full sets confirm.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull())
    base = stored(sketches(docs, words), "sketch")
    classes = stored(
        base.where("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "bands", "bits")).alias("r")).select("fingerprint", F.col("r.doc_id").alias("rep"), "r.bands", "r.bits"),
        "classes",
    )
    least = screen(num / den)
    keyed = classes.select("rep", "bits", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min(F.struct("rep", "bits")).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", F.col("p.rep").alias("pivot"), F.col("p.bits").alias("pivot_bits"))
    pivots = stored(pivots, "pivots")  # a table of its own, so that the join with a hot key's members can be split
    members = stored(keyed.join(pivots, "key"), "members")

    ids = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(lambda it: _sets(it, words), "doc_id long, size long, long_bits array<long>, shingles binary"), "sets")
    similar = F.col("common") * den >= (F.col("nu") + F.col("nv") - F.col("common")) * num

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """Set sizes and intersection of distinct pairs(u, v)."""
        full = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y")), "v").select("u", "v", "x", "y")
        return stored(full.mapInArrow(_compared, "u long, v long, nu long, nv long, common long"), name)

    star = members.where("rep <> pivot").where(estimated_similarity(F.col("bits"), F.col("pivot_bits")) >= least).select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct()
    tried = compared(star, "star")
    links = tried.where(similar).select("u", "v")
    found = stored(connected_components(links), "components")

    placed = members.select("key", "rep", "pivot").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "pivot", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", "n").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    mixed = stored(mixed, "mixed")
    away = tried.select(F.col("u").alias("rep"), F.col("v").alias("pivot"), (F.col("nu") + F.col("nv") - 2 * F.col("common")).alias("away"))
    traits = sets.select(F.col("doc_id").alias("rep"), "size", "long_bits").join(classes.select("rep", "bands"), "rep")
    open_ = placed.join(mixed, "key").join(away, ["rep", "pivot"], "left").withColumn("away", F.when(F.col("rep") == F.col("pivot"), 0).otherwise(F.col("away"))).join(traits, "rep")
    open_ = stored(open_.select("key", "main", "rep", "c", "away", "size", "long_bits", "bands"), "open")
    names = ("rep", "c", "away", "size", "long_bits", "bands")
    left = open_.where("c <> main").select("key", *(F.col(x).alias(f"{x}_u") for x in names))
    right = open_.select(F.col("key").alias("key_v"), "main", *(F.col(x).alias(f"{x}_v") for x in names))
    apart = F.coalesce(F.abs(F.col("away_u") - F.col("away_v")), F.lit(0))
    sizes = F.col("size_u") + F.col("size_v")
    agree = F.zip_with("bands_u", "bands_v", lambda x, y: x == y)
    rest = left.join(
        right,
        (F.col("key") == F.col("key_v"))
        & (F.col("c_u") != F.col("c_v"))
        & ((F.col("c_v") == F.col("main")) | (F.col("rep_u") < F.col("rep_v")))
        & (F.least("size_u", "size_v") * den >= F.greatest("size_u", "size_v") * num)
        & (apart * (den + num) <= sizes * (den - num))
        & (estimated_similarity(F.col("long_bits_u"), F.col("long_bits_v"), LONG) >= screen(num / den, LONG, 5.5))
        & (F.get("bands_u", F.array_position(agree, F.lit(True)).cast("int") - 1) == F.col("key")),
    )
    pairs = rest.select(F.greatest("rep_u", "rep_v").alias("u"), F.least("rep_u", "rep_v").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    more = compared(stored(pairs, "rest"), "more").where(similar).select("u", "v")
    every = connected_components(links.unionByName(more)) if more.limit(1).count() else found

    groups = classes.select("fingerprint", "rep").join(every.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "fingerprint").join(groups, "fingerprint", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over the whole documents table."""
    return settled(spark, lambda: near_duplicates(documents(spark, sf_dir), words=3, num=85, den=100), "op9")

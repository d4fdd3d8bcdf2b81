"""A training-corpus pipeline over documents: five stages, each one of the llm operators.

Every stage gets what the one before kept, written as Parquet and read again,
and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.decontamination import contaminated
from mailquarry.llm.minhash_dedup import near_duplicates
from mailquarry.llm.ppm_language import UNDETERMINED, identify, lettered, train
from mailquarry.llm.sampling import fold
from mailquarry.llm.sentencepiece_tokens import encode_documents
from mailquarry.llm.storage import settled, stored
from mailquarry.llm.suffix_dedup import remove_repeats


#: Bits a byte of the best code above which a text is in none of the learned languages; prose takes 2 to 3.
FOREIGN = 6.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language.

    Null, empty and letterless texts go, and those that even the best of the
    models codes in more than FOREIGN bits a byte. Where no language could be
    learned all lettered texts stay. Rows with a null doc_id go; a repeated
    doc_id goes if any of its texts does.
    """
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2))
    if model is None:
        return docs.where(F.col("doc_id").isNotNull() & lettered(F.col("text")))
    foreign = (F.col("lang_pred") == UNDETERMINED) | (F.col("bits_per_byte") > FOREIGN)
    rejected = settled(spark, lambda: identify(docs, model).where(foreign).select("doc_id"), "rejected")
    return docs.where(F.col("doc_id").isNotNull()).join(rejected, "doc_id", "left_anti").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest doc_id, of each group of near copies (five words, 0.8).

    Repeated rows of a kept document and rows with a null doc_id stay; a
    doc_id with several texts goes if one of them goes.
    """
    dropped = settled(spark, lambda: near_duplicates(docs, words=5, num=80, den=100).where(~F.col("kept")).select("doc_id"), "copies")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that a document with a smaller doc_id has; a document cut to nothing goes.

    Cuts can split a character: what is left of it becomes a replacement
    character. Rows with a null doc_id and repeated rows stay; texts under one
    doc_id don't remove from each other.
    """
    found = settled(spark, lambda: remove_repeats(docs).where("kept is not null").select("doc_id", F.col("tid").alias("_tid"), F.col("kept").alias("_kept")), "cut")
    out = docs.withColumn("_tid", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(found, ["doc_id", "_tid"], "left")
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.make_valid_utf8(F.col("_kept").cast("string")))
    out = out.withColumn("text", text).where((F.length("text") > 0) | F.col("_kept").isNull())
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (five words, containment 0.8).

    A repeated doc_id goes if any of its texts holds one; rows with a null doc_id stay.
    """
    leaked = settled(spark, lambda: contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with parity and round trip: (doc_id, n_tokens, ids_crc32, parity, round_trip), a row for each row.

    Only doc_id and text are looked at, so other columns can have any name.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near),
    ("repeated_strings", repeats),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The stages fit a model, link by graph and tokenize, which SQL can't express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

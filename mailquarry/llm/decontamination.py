"""Benchmark items inside documents, by size-partitioned containment MinHash; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.storage import documents, settled, stored

#: Hash functions for an item's sketch; an item with at most EXACT shingles is its own sketch.
HASHES, EXACT = 32, 16
#: Standard errors below the expected hits at which a candidate is still taken.
SLACK = 5.0
#: Rows of the sketch, and candidate pairs, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 250_000


def word_list(text: Column) -> Column:
    """Lowered runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: str, k: int, make) -> Column:
    """Distinct k-word shingles of the array column ``words``; a shorter text is one shingle, an empty one none."""
    n = F.size(words)
    one = make([F.array_join(words, " ")])
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: make([F.get(F.col(words), i + j) for j in range(k)]))
    return F.array_distinct(F.when(n >= k, many).when(n > 0, F.array(one)).otherwise(F.array().cast(many_type(make))))


def many_type(make) -> str:
    return "array<bigint>" if make is hashed else "array<string>"


def hashed(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def spelled(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts) if len(parts) > 1 else parts[0]


def item_sketches(items: DataFrame, k: int, containment: float) -> DataFrame:
    """(variant, size_partition, least, needed, hash): the minimum-hash shingles of each item and what makes a candidate.

    Items fall into size partitions by powers of two. Small ones keep all
    shingles; in the others each of HASHES functions keeps its minimum. A
    document can hold the share ``containment`` of an item only if it has that
    share of the partition's smallest size in shingles: ``least``, so short
    documents never meet the sketches of long items. The share of sketch
    shingles found in a document estimates the item's containment there,
    however long the document is; ``needed`` lies SLACK standard errors below
    the expected hits at the wanted containment.
    """
    sized = items.select("variant", _shingles("w", k, hashed).alias("all")).where(F.size("all") > 0)
    partition = F.floor(F.log2(F.size("all"))).cast("int")
    smallest = F.ceil(containment * F.pow(F.lit(2.0), F.col("size_partition")) - 1e-6).cast("int")
    least = F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda f: F.array_min(F.transform("all", lambda x: F.struct(F.xxhash64(f, x).alias("h"), x.alias("x"))))["x"])
    kept = sized.withColumn("size_partition", partition).withColumn("kept", F.when(F.size("all") <= EXACT, F.col("all")).otherwise(F.array_distinct(least)))
    m = F.size("kept")
    needed = F.greatest(F.lit(1), F.ceil(containment * m - SLACK * F.sqrt(containment * (1 - containment) * m)).cast("int"))
    return kept.select("variant", "size_partition", smallest.alias("least"), needed.alias("needed"), F.explode("kept").alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items of which a document holds ``percent`` of the distinct shingles or more.

    Case and anything but letters and digits don't count. An item with fewer
    words than a shingle is one shingle and is found only in a text of the
    same words: as a phrase, one to four common words would hit clean texts. Null, empty or wordless items and texts give no row; an item
    or document that is repeated gives one row. Rows with a null id are left
    out. Only doc_id, item_id and text are looked at. Candidates come from the
    sketches, the counts from the spelled-out shingles.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("variant", F.xxhash64("item_id", F.array_join("w", " "))).dropDuplicates(["variant"])
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    sketch = stored(item_sketches(items, words, percent / 100), "item_sketch")
    few = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = texts.select("doc_id", word_list(F.col("text")).alias("w")).select("doc_id", _shingles("w", words, hashed).alias("all"))
    # explode_outer: explode would infer a filter on the array, whose copy of the expression splits the text anew for every word
    found = sets.select("doc_id", F.size("all").alias("n"), F.explode_outer("all").alias("hash"))
    hits = found.join(F.broadcast(sketch) if few else sketch, "hash").where("n >= least")
    pairs = hits.groupBy("doc_id", "variant").agg(F.count("*").alias("hits"), F.min("needed").alias("needed")).where("hits >= needed").select("doc_id", "variant")
    pairs = stored(pairs, "leak_candidates")

    wanted = pairs.select("doc_id").distinct()
    small = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    spelled_docs = texts.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi").select("doc_id", word_list(F.col("text")).alias("w")).select("doc_id", _shingles("w", words, spelled).alias("in_doc"))
    spelled_items = items.select("variant", "item_id", _shingles("w", words, spelled).alias("in_item"))
    both = spelled_docs.join(F.broadcast(pairs) if small else pairs, "doc_id").join(spelled_items, "variant")
    counted = both.select("doc_id", "item_id", F.size("in_item").cast("bigint").alias("n_item"), F.size(F.array_intersect("in_item", "in_doc")).cast("bigint").alias("n_shared"))
    leaked = counted.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = leaked.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("share"), "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared")


def op5_containment(spark, sf_dir: str) -> DataFrame:
    """All benchmark items against all documents: five words, containment 0.8."""
    return settled(spark, lambda: contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "op5")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared FROM c JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""

"""Multi-party chat formatting: every speaker in turn becomes the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.llm.storage import stored

#: Turns in one row; the rendering of a longer dialogue goes on in the next row.
PART_TURNS = 4096
#: Ids of long dialogues that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
START, STOP = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """Text that can't open or close a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _parted(rows: DataFrame, part_turns: int) -> DataFrame:
    """The rows with the part that each turn's position in its dialogue puts it in.

    Only dialogues over ``part_turns`` turns are sorted, all together by
    ranges, so no dialogue has to fit in a task: positions are counted within
    ranges and shifted by what the earlier ranges of the dialogue hold.
    """
    long_ = rows.groupBy("conv_id").count().where(F.col("count") > part_turns).select("conv_id")
    many = long_.limit(BROADCAST_IDS + 1).count()
    if not many:
        return rows.withColumn("part", F.lit(0).cast("long"))
    spark = rows.sparkSession
    long_ = F.broadcast(long_) if many <= BROADCAST_IDS else long_
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.join(long_, "conv_id", "left_semi")
    ordered = own.repartitionByRange(n, "conv_id", "turn", "speaker", F.substring("content", 1, 64)).sortWithinPartitions("conv_id", "turn", "speaker", "content")
    ordered = stored(ordered.withColumn("_m", F.monotonically_increasing_id()), "turns").withColumn("_p", F.shiftright("_m", 33))
    ranges = ordered.groupBy("conv_id", "_p").agg(F.min("_m").alias("_lo"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("conv_id", "_p", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo")).alias("_shift"))
    ranges = F.broadcast(ranges) if many <= n else ranges
    placed = ordered.join(ranges, ["conv_id", "_p"]).withColumn("part", F.floor((F.col("_m") + F.col("_shift")) / part_turns).cast("long"))
    return rows.join(long_, "conv_id", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(placed.drop("_m", "_p", "_shift"))


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each dialogue and participant, rendered with that participant as the assistant.

    ``turns`` has conv_id, turn, role (the speaker's name) and text; other
    columns are not looked at. Participants are the distinct roles but the
    ``context_roles``, whose turns are rendered as they are. Other speakers
    become users with a name. Result: conv_id, perspective, part, n_turns,
    rendered, mask (spans of characters to learn from: the participant's own
    texts with their end markers).

    There is one rendering for each dialogue and participant, of all turns. It
    is stored in parts of ``part_turns`` turns by position, so that an endless
    dialogue is many rows on many tasks: the parts joined in order are the
    rendering, and mask spans count from the start of their part. Turn numbers
    only give the order.

    Turns go by number, equal numbers by role and text, null numbers first (as
    -1). A null or empty role is ``unknown``; a null text is empty; markers in
    a text are broken up; line ends in a name become spaces. Repeated rows are
    repeated turns. Rows with a null conv_id form no dialogue. A dialogue
    without a participant has no row.
    """
    name = F.trim(F.regexp_replace(F.coalesce(F.col("role"), F.lit("")), r"[\x00-\x1F\x7F]+", " "))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.when(name == "", F.lit("unknown")).otherwise(_clean(name)).alias("speaker"),
        _clean(F.col("text").cast("string")).alias("content"),
    )
    rows = _parted(rows, part_turns)
    speakers = rows.where(~F.col("speaker").isin(list(context_roles))).groupBy("conv_id").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))
    dialogues = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content"))).alias("turns"))
    each = dialogues.join(speakers, "conv_id").select("conv_id", "part", "turns", F.explode("speakers").alias("perspective"))

    def head(t: Column) -> Column:
        who = F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"].isin(list(context_roles)), t["speaker"]).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(START), who, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["content"], F.lit(STOP)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")))
    each = each.withColumn("pieces", pieces)
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["head"])
        last = first + F.length(p["body"])
        return F.struct((last + 1).cast("bigint").alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(first.cast("bigint").alias("start"), last.cast("bigint").alias("stop"))))).otherwise(acc["spans"]).alias("spans"))

    return each.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("mask"),
    )


def op1_rotation(spark, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its participants; spans as text for comparison."""
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "rendered", spans.alias("mask_spans"))


OP1_SQL = """
WITH speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
pieces AS (
  SELECT c.conv_id, s.perspective, c.turn, c.role = s.perspective AS own,
    '<|im_start|>' || CASE WHEN c.role = s.perspective THEN 'assistant' WHEN c.role = 'system' THEN 'system' ELSE 'user name=' || c.role END || chr(10) AS head,
    c.text || '<|im_end|>' AS body
  FROM conversations c JOIN speakers s ON c.conv_id = s.conv_id),
parted AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn) - 1) // 4096 AS BIGINT) AS part FROM pieces),
placed AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn) AS BIGINT) - 1 AS stop FROM parted)
SELECT conv_id, perspective, part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY turn), '') AS mask_spans
FROM placed GROUP BY conv_id, perspective, part
"""

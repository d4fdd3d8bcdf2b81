"""Ordered picks within groups: worst, first, unique match, target and context, runs, budgets, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst_by_priority(rows: DataFrame, keys: list[str], value: Column, priority: dict[str, int], order: Column, default: int = 50) -> DataFrame:
    """The most adverse value of each group, the first of equals, and how many values there were."""
    rank = F.coalesce(F.create_map(*(x for k, v in priority.items() for x in (F.lit(k), F.lit(v))))[F.lower(value)], F.lit(default))
    picked = rows.withColumn("_rank", rank).withColumn("_order", -order)
    return picked.groupBy(*keys).agg(F.max_by(value, F.struct("_rank", "_order")).alias("worst"), F.max("_rank").alias("priority"), F.count("*").alias("results"))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stable_hop_order(hops: DataFrame, message: str, header_index: str, ts: str) -> DataFrame:
    """route_index of each hop: reversed header order, by time only if every hop of the message has one."""
    all_valid = F.min(F.col(ts).isNotNull()).over(Window.partitionBy(message))
    order = Window.partitionBy(message).orderBy(F.when(F.col("_all"), F.col(ts)), F.desc(header_index))
    return hops.withColumn("_all", all_valid).withColumn("route_index", F.row_number().over(order) - 1).drop("_all")


def unique_match(left: DataFrame, right: DataFrame, on: Column, left_id: str, value: str, alias: str) -> DataFrame:
    """``value`` of the only matching right row; null if none or several match."""
    hit = left.join(right, on, "left").groupBy(left_id).agg(F.count(value).alias("_n"), F.first(value, ignorenulls=True).alias("_v"))
    return hit.select(left_id, F.when(F.col("_n") == 1, F.col("_v")).alias(alias))


def target_and_context(segments: DataFrame, message: str, position: str, score: str) -> DataFrame:
    """recommended_role: the first segment with the highest score is the target, its neighbours and the outer one context."""
    target = F.first(position).over(Window.partitionBy(message).orderBy(F.desc(score), position).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = (F.abs(F.col(position) - F.col("_target")) == 1) | (F.col(position) == 0)
    role = F.when(F.col(position) == F.col("_target"), "target").when(near, "context").otherwise("excluded")
    return segments.withColumn("_target", target).withColumn("recommended_role", role).drop("_target")


def runs(lines: DataFrame, keys: list[str], position: str, value: Column) -> DataFrame:
    """run, run_length, place and place_from_end of each line within its run of equal values (gaps and islands)."""
    by = Window.partitionBy(*keys).orderBy(position)
    new = F.when(F.lag("_v").over(by).eqNullSafe(F.col("_v")), 0).otherwise(1)
    out = lines.withColumn("_v", value).withColumn("_new", new).withColumn("run", F.sum("_new").over(by))
    inside = Window.partitionBy(*keys, "run")
    return out.withColumn("run_length", F.count("*").over(inside)).withColumn("place", F.row_number().over(inside.orderBy(position))).withColumn("place_from_end", F.col("run_length") - F.col("place") + 1).drop("_v", "_new")


def collapsed_runs(lines: DataFrame, keys: list[str], position: str, shape: Column, least: int = 8, head: int = 3, tail: int = 2) -> DataFrame:
    """Lines that stay when long runs of one shape keep their first and last lines; ``omitted`` stands at the last head line."""
    marked = runs(lines, keys, position, shape)
    long = F.col("run_length") >= least
    keep = ~long | (F.col("place") <= head) | (F.col("place_from_end") <= tail)
    return marked.where(keep).withColumn("omitted", F.when(long & (F.col("place") == head), F.col("run_length") - head - tail).otherwise(0))


def section_choice(sections: DataFrame, message: str, index: str, score: str, budget: int) -> DataFrame:
    """First, last and the highest-scored middle sections, equal ones by place, ``budget`` in all."""
    own = Window.partitionBy(message)
    out = sections.withColumn("_last", F.max(index).over(own)).withColumn("_middle", (F.col(index) > 0) & (F.col(index) < F.col("_last")))
    rank = F.row_number().over(Window.partitionBy(message, "_middle").orderBy(F.desc(score), index))
    return out.withColumn("_rank", rank).where(~F.col("_middle") | (F.col("_rank") <= budget - 2)).drop("_last", "_middle", "_rank")


def budgeted(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int, width: int | None = None) -> DataFrame:
    """kept: how much of each row fits a running budget; truncated: whether something is missing.

    With ``width`` the first order column is a whole number that is cut into
    ranges of that width: sums are taken within ranges and shifted by what the
    ranges before hold, so that a key with very many rows is not one task.
    """
    earlier = lambda w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if width is None:
        before = earlier(Window.partitionBy(*keys).orderBy(*order))
    else:
        rows = rows.withColumn("_range", F.floor(F.col(order[0]) / width))
        sums = rows.groupBy(*keys, "_range").agg(F.sum(size).alias(size))
        shift = sums.select(*keys, "_range", earlier(Window.partitionBy(*keys).orderBy("_range")).alias("_shift"))
        rows = rows.join(shift, [*keys, "_range"])
        before = F.col("_shift") + earlier(Window.partitionBy(*keys, "_range").orderBy(*order))
    rows = rows.withColumn("_before", before)
    before = F.col("_before")
    kept = F.greatest(F.lit(0), F.least(F.col(size), F.lit(budget) - before))
    return rows.withColumn("kept", kept.cast("bigint")).withColumn("truncated", F.col("kept") < F.col(size)).drop("_before", "_shift", "_range")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def family_score(signals: DataFrame, message: str) -> DataFrame:
    """Per family the largest weight if any is positive, else the smallest; their sum within 0 and 100."""
    family = signals.groupBy(message, "family").agg(F.when(F.max("weight") > 0, F.max("weight")).otherwise(F.min("weight")).alias("w"))
    return family.groupBy(message).agg(F.greatest(F.lit(0), F.least(F.lit(100), F.sum("w"))).cast("bigint").alias("score"), F.count("*").alias("families"))


def new_account_for_sender(uses: DataFrame, sender: str, account: str, message: str, ts: str) -> DataFrame:
    """First use of an account by a sender that used another one in an earlier message.

    A message that is seen twice changes nothing.
    """
    seen = uses.where(F.col(sender).isNotNull() & F.col(account).isNotNull()).dropDuplicates([sender, account, message])
    first_use = seen.groupBy(sender, account).agg(F.min(F.struct(ts, message)).alias("_first"))
    before = F.min("_first").over(Window.partitionBy(sender))
    return first_use.withColumn("_known", before).where(F.col("_known") < F.col("_first")).select(sender, account, F.col(f"_first.{message}").alias(message), F.col(f"_first.{ts}").alias(ts))

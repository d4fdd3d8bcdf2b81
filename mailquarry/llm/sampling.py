"""Bounded training samples and the contract's folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def piece_of(text: str, order: str, size: int) -> Column:
    """A text of at most ``size`` characters, or a piece of that length from a place that a hash of ``order`` gives."""
    spare = F.length(text) - F.lit(size)
    at = F.when(spare > 0, F.pmod(F.xxhash64(F.lit(29), order), spare.cast("bigint") + 1).cast("int")).otherwise(0)
    return F.col(text).substr(at + 1, F.lit(size))


#: Values of the group column whose counts are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000


def bounded_sample(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """(order, group) of about ``size`` rows, and never more, of each value of ``group``, by a hash of ``order``.

    Only these two columns are read. A threshold from the group's count keeps
    about one and a half times ``size`` rows before the exact cut, so no task
    meets a whole large group. Null groups are left out.
    """
    rows = rows.where(F.col(group).isNotNull()).select(order, group).withColumn("_h", F.xxhash64(F.lit(17), order))
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    if counts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        counts = F.broadcast(counts)
    share = F.lit(1.5 * size + 20) / F.col("_n")
    near = rows.join(counts, group).where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h", order))
    return near.withColumn("_r", rank).where(F.col("_r") <= size).select(order, group)

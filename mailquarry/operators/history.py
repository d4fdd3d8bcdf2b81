"""Questions over the stored history: tones, durations, activity, reasons, latest record of each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TONES = ("danger", "review", "safe")


def tone_counts(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records and records of each tone, for each value of ``by`` or over all; shares are null without records."""
    counts = [F.count_if(F.col("tone") == t).alias(t) for t in TONES]
    out = history.groupBy(*(by or [])).agg(F.count("*").alias("total"), *counts)
    return out.select("*", *((F.col(t) / F.nullif(F.col("total"), F.lit(0))).alias(f"{t}_share") for t in TONES))


def median_duration(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact median of the positive finite durations; null without any."""
    d = F.col("duration").cast("double")
    ok = (d > 0) & ~F.isnan(d) & (d != float("inf"))
    return history.groupBy(*(by or [])).agg(F.median(F.when(ok, d)).alias("median_duration"), F.count_if(ok).alias("timed"))


def activity_buckets(history: DataFrame, first: Column, last: Column) -> DataFrame:
    """Tone counts by period between two days, both included: (bucket, from_day, to_day, danger, review, safe, total).

    Up to 10 days the periods are days, up to 62 days weeks from the first day
    on, beyond that calendar months (the first one from the first day). More
    than 12 periods are joined with their neighbours, so that at most 12
    remain. Empty periods stay. ``history`` has day (DATE) and tone; the
    records are counted by day before they meet the few periods.
    """
    spark = history.sparkSession
    span = spark.range(1).select(first.cast("date").alias("a"), F.date_add(last.cast("date"), 1).alias("z"))
    days = F.datediff("z", "a")
    step = F.when(days > 10, 7).otherwise(1)
    by_days = F.transform(F.sequence(F.lit(0), F.floor((days - 1) / step).cast("int")), lambda i: F.date_add(F.col("a"), (i * step).cast("int")))
    months = F.months_between(F.trunc(F.date_sub("z", 1), "month"), F.trunc("a", "month")).cast("int")
    by_months = F.transform(F.sequence(F.lit(0), months), lambda i: F.greatest(F.col("a"), F.add_months(F.trunc("a", "month"), i)))
    starts = F.when(days > 62, by_months).otherwise(by_days)
    stride = F.greatest(F.lit(1), F.ceil(F.size("starts") / 12)).cast("int")
    cut = span.select("z", starts.alias("starts")).select("z", F.filter("starts", lambda d, i: i % stride == 0).alias("starts"))
    bars = cut.select("z", "starts", F.posexplode("starts").alias("bucket", "from_day")).select("bucket", "from_day", F.coalesce(F.get("starts", F.col("bucket") + 1), F.col("z")).alias("to_day"))
    daily = history.groupBy("day").agg(F.count("*").alias("n"), *(F.count_if(F.col("tone") == t).alias(t) for t in TONES))
    hit = bars.join(daily, (F.col("day") >= F.col("from_day")) & (F.col("day") < F.col("to_day")), "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(a) for c, a in ((*((t, t) for t in TONES), ("n", "total")))]
    return hit.groupBy("bucket", "from_day", "to_day").agg(*sums)


def reason_counts(reasons: DataFrame, message: str = "msg_id", top: int | None = 5) -> DataFrame:
    """Each reason counts once for each message; most frequent first, equal ones by name; ``top`` of them."""
    out = reasons.where(F.col("reason").isNotNull()).select(message, "reason").distinct().groupBy("reason").agg(F.count("*").alias("messages"))
    return out.orderBy(F.desc("messages"), "reason").limit(top) if top else out


def latest_by_fingerprint(history: DataFrame, fingerprint: Column, newest: Column, tie: Column) -> DataFrame:
    """The newest record of each fingerprint; equal times are settled by the smallest ``tie``."""
    w = Window.partitionBy("_fp").orderBy(newest.desc_nulls_last(), tie)
    return history.withColumn("_fp", fingerprint).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_fp", "_rn")


def message_fingerprint(sha256: Column, message_id: Column, sender: Column, to: Column, subject: Column, date: Column) -> Column:
    """The content hash, else the message id, else the four envelope fields, folded."""
    folded = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (sender, to, subject, date)]
    full = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    return F.when(full(sha256), F.concat(F.lit("sha256:"), sha256)).when(full(message_id), F.concat(F.lit("message-id:"), F.lower(F.trim(message_id)))).otherwise(F.concat_ws("|", *folded))


def period_start(period: str, now: Column) -> Column | None:
    """First instant of a period that ends now; None for all time.

    A month back from the 31st lands on the last day of a shorter month.
    """
    day = F.date_trunc("day", now)
    if period == "all":
        return None
    if period == "today":
        return day
    if period == "week":
        return day - F.expr("INTERVAL 6 DAYS")
    months = {"month": 1, "3m": 3, "6m": 6, "9m": 9, "12m": 12}[period]
    return F.add_months(day.cast("date"), -months).cast("timestamp")


def in_period(ts: Column, period: str, now: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Whether a time lies in a period; later than now never counts but for a custom range of whole days."""
    if period == "custom":
        return F.coalesce((first.cast("date") <= last.cast("date")) & (ts >= first.cast("date").cast("timestamp")) & (ts < F.date_add(last.cast("date"), 1).cast("timestamp")), F.lit(False))
    start = period_start(period, now)
    ok = ts <= now
    return F.coalesce(ok if start is None else ok & (ts >= start), F.lit(False))


def replaced(history: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Shallow merge of patches by record id: a patch's non-null columns win."""
    p = patches.select("record_id", *(F.col(c).alias(f"_new_{c}") for c in columns))
    return history.join(p, "record_id", "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in history.columns))

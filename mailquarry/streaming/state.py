"""What is kept between messages that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailquarry.operators.payments import TTL_DAYS
from mailquarry.streaming.quota import Window

_TTL = TTL_DAYS * 86_400.0


def payment_alerts(uses: DataFrame, late: str = "7 days") -> DataFrame:
    """Stream of (sender, account, msg_id, change_phrase, at) -> alerts (sender, account, msg_id, level).

    State of a sender: its accounts with the messages and times they were seen
    in. Only an account that is new to a sender known for others is reported;
    the same message twice changes nothing; entries end after 730 days, and a
    sender that is silent for so long, by the watermark, leaves the state.
    Rows that are ``late`` by more are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accounts, messages, times = (list(x) for x in state.get) if state.exists else ([], [], [])
        out = []
        rows = pd.concat(list(frames)).sort_values(["at", "msg_id", "account"])
        for r in rows.itertuples():
            fresh = [k for k, t in enumerate(times) if t >= r.at - _TTL]
            others = {accounts[k] for k in fresh if messages[k] != r.msg_id}
            again = any(accounts[k] == r.account and messages[k] == r.msg_id for k in fresh)
            if others and r.account not in others and not again:
                out.append((key[0], r.account, r.msg_id, "HIGH" if r.change_phrase else "MEDIUM"))
            if not again:
                accounts, messages, times = [accounts[k] for k in fresh] + [r.account], [messages[k] for k in fresh] + [r.msg_id], [times[k] for k in fresh] + [float(r.at)]
        state.update((accounts, messages, times))
        state.setTimeoutTimestamp(int((rows["at"].max() + _TTL) * 1000) + 1)
        yield pd.DataFrame(out, columns=["sender", "account", "msg_id", "level"])

    rows = uses.where("sender is not null and account is not null and at is not null").withWatermark("at", late).selectExpr("at AS event_time", "sender", "account", "msg_id", "coalesce(change_phrase, false) AS change_phrase", "unix_micros(at) / 1000000D AS at")
    return rows.groupBy("sender").applyInPandasWithState(step, "sender string, account string, msg_id string, level string", "accounts array<string>, messages array<string>, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def quota_admissions(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of (key, call_id, ts) -> (key, call_id, admitted) under the sliding quotas; a key that is silent for a day, by the watermark, leaves the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["at", "call_id"])
        admitted = [window.admit(at) for at in rows["at"]]
        state.update((list(window.times),))
        state.setTimeoutTimestamp(int((rows["at"].max() + 86_400) * 1000) + 1)
        yield pd.DataFrame({"key": key[0], "call_id": rows["call_id"], "admitted": admitted})

    rows = calls.where("key is not null and ts is not null").withWatermark("ts", late).selectExpr("ts AS event_time", "key", "call_id", "unix_micros(ts) / 1000000D AS at")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, call_id long, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def first_baselines(uses: DataFrame, late: str = "7 days", ttl_days: int = 90) -> DataFrame:
    """Stream of (partner, sender, action_domains, reply_domains, at) -> baselines written: the first use, then none until it has expired."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        written = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("at").itertuples():
            if written is None or r.at >= written + ttl_days * 86_400:
                written = float(r.at)
                out.append((*key, list(r.action_domains), list(r.reply_domains), pd.Timestamp(r.at, unit="s")))
        state.update((written,))
        state.setTimeoutTimestamp(int((written + ttl_days * 86_400) * 1000) + 1)
        yield pd.DataFrame(out, columns=["partner", "sender", "action_domains", "reply_domains", "written_at"])

    rows = uses.where("partner is not null and sender is not null and at is not null").withWatermark("at", late).selectExpr("at AS event_time", "partner", "sender", "coalesce(action_domains, array()) AS action_domains", "coalesce(reply_domains, array()) AS reply_domains", "unix_micros(at) / 1000000D AS at")
    return rows.groupBy("partner", "sender").applyInPandasWithState(step, "partner string, sender string, action_domains array<string>, reply_domains array<string>, written_at timestamp", "written double", "append", GroupStateTimeout.EventTimeTimeout)


def directory_updates(imports: DataFrame) -> DataFrame:
    """Stream of (directory, sequence, record_id) -> the same with ``accepted``: a sequence that isn't above the last accepted one is a rollback.

    All records of one sequence that arrive together share its answer; the
    last number of a directory is kept for good, as it must be.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["sequence", "record_id"])
        accepted = []
        start = last
        for s in rows["sequence"]:
            good = start is None or s > start
            accepted.append(good)
            last = int(s) if good and (last is None or s > last) else last
        state.update((last,))
        yield pd.DataFrame({"directory": key[0], "sequence": rows["sequence"], "record_id": rows["record_id"], "accepted": accepted})

    rows = imports.where("directory is not null and sequence is not null").select("directory", "sequence", "record_id")
    return rows.groupBy("directory").applyInPandasWithState(step, "directory string, sequence long, record_id string, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def daily_activity(history: DataFrame, late: str = "2 days") -> DataFrame:
    """Stream of (ts, tone) -> tumbling tone counts by day; days close when the watermark has passed them."""
    return history.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("total"), *(F.count_if(F.col("tone") == t).alias(t) for t in ("danger", "review", "safe"))).select(F.col("w.start").alias("day"), "total", "danger", "review", "safe")


def newest_by_fingerprint(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest record of each fingerprint in versioned tables under ``path``.

    Batch n reads version n - 1 and writes version n; a batch that is repeated
    writes the same version again, so the one before it is kept and those
    before that are deleted.
    """

    def sink(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch
        if n > 0:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{n - 1}"))
        best = rows.groupBy("fingerprint").agg(F.max_by(F.struct(*rows.columns), F.struct("analyzed_at", "record_id")).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/v{n}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return sink

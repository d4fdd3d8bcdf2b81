from __future__ import annotations

import datetime as dt

from mailquarry.sources import tables
from mailquarry.streaming import quota, state


def batches(spark, tmp_path, schema, *groups):
    """A file stream with one batch for each group of rows."""
    src = tmp_path / "in"
    for k, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


def test_payment_memory(spark, tmp_path):
    schema = "sender string, account string, msg_id string, change_phrase boolean, at timestamp"
    s = batches(spark, tmp_path, schema, [("s", "A", "m1", False, at(1))], [("s", "B", "m2", True, at(2))], [("s", "B", "m2", True, at(2)), ("t", "Z", "m9", True, at(2))], [("s", "A", "m3", False, at(3)), ("s", "C", "m3", False, at(3))])
    got = sorted((r.sender, r.account, r.msg_id, r.level) for r in run(state.payment_alerts(s), tmp_path, "payments"))
    assert got == [("s", "B", "m2", "HIGH"), ("s", "C", "m3", "MEDIUM")]


def test_quota_stream_equals_batch(spark, tmp_path):
    schema = "key string, call_id long, ts timestamp"
    rows = [("k", i, at(0, i * 7)) for i in range(8)] + [("q", 100 + i, at(i)) for i in range(3)]
    batch = {r.call_id: r.admitted for r in quota.admitted_calls(spark.createDataFrame(rows, schema)).collect()}
    stream = {r.call_id: r.admitted for r in run(state.quota_admissions(batches(spark, tmp_path, schema, rows[:5], rows[5:])), tmp_path, "quota")}
    assert batch == stream
    # four calls within a minute; rejected ones leave no trace
    assert [batch[i] for i in range(8)] == [True] * 4 + [False] * 4 and all(batch[100 + i] for i in range(3))


def test_day_limit():
    w = quota.Window()
    assert sum(w.admit(t * 20.0) for t in range(2000)) == 500
    assert w.admit(86_400.0 * 2)


def test_newest_record_wins(spark, tmp_path):
    sink, schema = state.newest_by_fingerprint(f"file://{tmp_path}/h"), "fingerprint string, analyzed_at timestamp, record_id string"
    b0 = spark.createDataFrame([("f", at(1), "a"), ("g", at(1), "b")], schema)
    b1 = spark.createDataFrame([("f", at(5), "c"), ("g", at(0), "d")], schema)
    sink(b0, 0), sink(b1, 1), sink(b1, 1)
    assert {(r.fingerprint, r.record_id) for r in spark.read.parquet(f"file://{tmp_path}/h/v1").collect()} == {("f", "c"), ("g", "b")}


def test_daily_activity(spark, tmp_path):
    schema = "ts timestamp, tone string"
    day = lambda d: dt.datetime(2024, 1, d, 12)
    s = batches(spark, tmp_path, schema, [(day(1), "danger"), (day(1), "safe")], [(day(9), "safe")], [(day(20), "safe")])
    got = run(state.daily_activity(s), tmp_path, "daily")
    assert [(r.total, r.danger) for r in got if r.day.day == 1] == [(2, 1)]


def test_mailbox_source(spark, tmp_path):
    import os

    for k in range(5):
        p = tmp_path / f"{k}.eml"
        p.write_bytes(b"From: a@b.test\n\nx%d" % k)
        os.utime(p, (1000 + k, 1000 + k))
    spark.dataSource.register(tables.MailboxSource)
    got = spark.read.format("mailbox").option("folder", f"file://{tmp_path}").option("newest", "2").load().collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["3.eml", "4.eml"]
    assert {bytes(r.content)[-2:] for r in got} == {b"x3", b"x4"}


def test_jsonl(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "1", "prediction": "phishing", "seconds": 1.5}\nbroken\n')
    rows = tables.jsonl(spark, f"file://{tmp_path}/p.jsonl", tables.PREDICTIONS).collect()
    assert [(r.id, r.prediction, r._bad) for r in rows] == [("1", "phishing", None), (None, None, "broken")]


def test_first_baseline_holds_until_it_expires(spark, tmp_path):
    schema = "partner string, sender string, action_domains array<string>, reply_domains array<string>, at timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    s = batches(spark, tmp_path, schema, [("p", "s", ["a"], None, day(0)), ("p", "s", ["b"], None, day(1))], [("p", "s", ["c"], None, day(20)), ("q", "s", ["z"], ["y"], day(20))], [("p", "s", ["d"], None, day(95))])
    got = sorted((r.partner, r.action_domains) for r in run(state.first_baselines(s), tmp_path, "baselines"))
    assert got == [("p", ["a"]), ("p", ["d"]), ("q", ["z"])]


def test_directory_rollback_is_refused(spark, tmp_path):
    schema = "directory string, sequence long, record_id string"
    s = batches(spark, tmp_path, schema, [("d", 3, "a"), ("d", 3, "b")], [("d", 2, "c"), ("e", 1, "x")], [("d", 4, "e"), ("d", 3, "f"), (None, 1, "g")])
    got = {r.record_id: r.accepted for r in run(state.directory_updates(s), tmp_path, "directory")}
    assert got == {"a": True, "b": True, "c": False, "x": True, "e": True, "f": False}

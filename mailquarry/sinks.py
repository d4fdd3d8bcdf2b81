"""Outputs: JSON-safe reports, JSON lines, evaluation reports, privacy counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _has_binary(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_binary(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_binary(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_binary(kind.keyType) or _has_binary(kind.valueType)
    return isinstance(kind, T.BinaryType)


def _without_binary(column, kind: T.DataType):
    """The column without binary values at any depth; None if nothing is left of it."""
    if not _has_binary(kind):
        return column
    if isinstance(kind, T.StructType):
        kept = [(f.name, _without_binary(column[f.name], f.dataType)) for f in kind.fields]
        kept = [c.alias(n) for n, c in kept if c is not None]
        return F.when(column.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, T.ArrayType):
        probe = _without_binary(F.lit(None), kind.elementType) if not isinstance(kind.elementType, T.StructType) else _without_binary(F.col("_"), kind.elementType)
        return None if probe is None else F.transform(column, lambda x: _without_binary(x, kind.elementType))
    if isinstance(kind, T.MapType) and not _has_binary(kind.keyType):
        probe = _without_binary(F.col("_"), kind.valueType)
        return None if probe is None else F.transform_values(column, lambda k, v: _without_binary(v, kind.valueType))
    return None


def json_safe(df: DataFrame) -> DataFrame:
    """Without binary values at any depth of structs, arrays and maps."""
    kept = [(f.name, _without_binary(F.col(f.name), f.dataType)) for f in df.schema.fields]
    return df.select(*(c.alias(n) for n, c in kept if c is not None))


def write_reports(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    json_safe(df).write.mode("errorifexists").json(path)


def save_history(df: DataFrame, path: str) -> None:
    """Write a table beside its place and move it there, so that a reader sees all of it or the one before."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, draft, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".draft", ".before"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(draft, True)
    json_safe(df).write.parquet(path + ".draft")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(draft, target)
    fs.delete(old, True)


def redacted_preview(content, limit: int = 750_000):
    """A raw message with long encoded blocks replaced by a marker, cut at ``limit`` characters."""
    text = F.decode(content, "ISO-8859-1")
    return F.left(F.regexp_replace(text, r"(?m)(^[A-Za-z0-9+/=]{60,}\r?\n){3,}", "[attachment data removed]\n"), F.lit(limit))


def evaluation_report(pairs: DataFrame, timings: DataFrame, fields: DataFrame, path: str) -> None:
    """Metrics, latency and semantic fields as one JSON line: the report of an evaluation."""
    from mailquarry.operators import evaluation as ev

    by = F.array_sort(F.collect_list(F.struct("field", "correct", "total", "share"))).alias("fields")
    one = ev.metrics(pairs).crossJoin(ev.latency(timings)).crossJoin(fields.agg(by))  # one row each
    one.coalesce(1).write.mode("errorifexists").json(path)


def privacy_audit(texts: DataFrame) -> DataFrame:
    """Counts over the column ``text``: rows, rows with addresses, links, IPv4 addresses; distinct account-like strings and valid ones."""
    from mailquarry.functions.text import valid_iban

    t = F.col("text")
    rows = texts.agg(
        F.count("*").alias("rows"), F.count_if(t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("with_mail"), F.count_if(t.rlike(r"(?i)https?://")).alias("with_link"),
        F.count_if(t.rlike(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")).alias("with_ipv4"),
    )
    accounts = texts.select(F.explode(F.regexp_extract_all(t, F.lit(r"([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})"), 1)).alias("a")).distinct()
    return rows.crossJoin(accounts.agg(F.count("*").alias("accounts"), F.count_if(valid_iban(F.col("a"))).alias("valid_accounts")))

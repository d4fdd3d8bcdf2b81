"""Catalogs, evaluation sets and stored reports as DataFrames; schemas are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PREDICTIONS = "model string, id string, prediction string, seconds double, json_valid boolean, semantics map<string,string>"
LABELS = "id string, file string, label string, category string, expected_behavior string, expected_semantics map<string,string>, sha256 string, content_fingerprint string, split string"
HISTORY = "record_id string, user_id string, analyzed_at timestamp, fingerprint string, tone string, duration_ms bigint, reasons array<string>"


def reports(spark, path: str, schema: str):
    """Stored reports, one JSON object a line, back as rows of ``schema``; lines that aren't are counted in ``_bad``."""
    from pyspark.sql import functions as F

    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("_bad", F.col("_bad").isNotNull())


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines set; lines that don't parse come as rows with ``_bad`` set."""
    return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)


def catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON catalog as a dimension."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def save_history(records: DataFrame, path: str) -> None:
    """Append; duplicates are settled when the history is read."""
    records.write.mode("append").parquet(path)


class MailboxSource(DataSource):
    """Newest messages of a mailbox: ``spark.read.format("mailbox")`` with option ``folder``, and ``newest`` from 1 to 20.

    The offline mailbox is a directory; a provider's client takes the place of
    ``_names`` and ``_content``. A message is read by the task it belongs to.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _MailboxReader(self.options)


class _Message(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _MailboxReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["folder"]
        self.newest = min(20, max(1, int(options.get("newest", "20"))))

    def partitions(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(base)) if f.is_file and f.base_name.lower().endswith(".eml")]
        return [_Message(f.path) for f in sorted(files, key=lambda f: (f.mtime, f.path), reverse=True)[: self.newest]]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(partition.path) as f:
            yield partition.path, f.read()

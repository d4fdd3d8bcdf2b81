"""Tables and files that every executor and the driver can see.

Long jobs cut their lineage by writing a table under the folder named in
``spark.checkpoint.dir`` and reading it back: a lost executor then costs a
re-read, never a recomputation of the chain before it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes in one Arrow batch; bounds what a Python worker holds at once.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mailquarry-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_scratch: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a table; the tables it wrote on the way are deleted and their shuffle files freed."""
    out = fresh_path(spark, name)
    _scratch.append([])
    try:
        df = make()
        df.write.parquet(out)
        schema = df.schema
        del df
    finally:
        made = _scratch.pop()
    for path in made:
        dropped(spark, path)
    freed(spark)
    return spark.read.schema(schema).parquet(out)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed() -> None:
    """Give a Python worker's free memory back to the system, after a step that used much of it.

    Arrow's own pool keeps what it frees, so from the first call on the system's is used.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where a local session names none, as in tests, an own one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tickforge-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has materialized, once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: later plans start from the files, which `clear` removes."""
    path = f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and its Python workers, each of which holds one whole.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: by rows alone, a batch of long texts is as large as its partition."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name)) or 0) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of `df`; for a file scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scaled(df: DataFrame, bytes_each: int, least: int, most: int = 1 << 20) -> int:
    """How many parts of about `bytes_each` the rows of `df` make, within bounds; 4 * least if Catalyst doesn't know its size
    (frames made from local rows or RDDs; a table written and read back has one)."""
    size = size_in_bytes(df)
    return 4 * least if size >= 1 << 60 else max(least, min(most, -(-size // bytes_each)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

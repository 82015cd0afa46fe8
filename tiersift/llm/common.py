"""What the operators share: the cluster's shared folder, cut lineage and batch limits."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and their lower case, for translate(); other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors and the driver can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/tiersift-shared"  # the driver and the executors are one process
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: later stages and lost executors don't recompute it.

    The folder goes when the driver ends, or before by discard().
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    store, at = _at(spark, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by cut() that nothing reads any more."""
    for df in tables:
        store, at = _at(df.sparkSession, df._cut_folder)
        store.delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the application's executors, once: their Python workers import it."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver's own: Spark serves the file from there as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(spark.sparkContext.applicationId)


def limit_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes: the same bounds for all operators."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy() -> None:
    """Gives memory that a task no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, judge: Callable[[], Callable[[list], list[bool]]], columns: list[str]) -> DataFrame:
    """The rows of df for which judge()(column, ...) holds; all columns of df stay, whatever their names.

    judge is called once a task and returns a function from lists of values to a list of booleans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = judge()
        for b in batches:
            yield b.filter(pa.array(verdict(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]), pa.bool_()))

    return map_rows(df, run, df.schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

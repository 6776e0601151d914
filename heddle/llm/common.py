"""What the operators of this subpackage share: durable tables, packing of binary columns, hashing helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where it is unset and all run here."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="heddle-"))
    return where.rstrip("/")


_own: dict[str, str] = {}


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str) -> str:
    """A place for a table; what is still there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/heddle/{label}-{uuid.uuid4().hex}"
    files, p = _files(spark, path)
    files.mkdirs(p.getParent())
    files.deleteOnExit(p)
    _made.append(path)
    return path


_made: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._heddle_path = path
    return out


def path_of(table: DataFrame) -> str:
    """Where `materialise` put a table."""
    return table._heddle_path


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, p = _files(spark, path)
        files.delete(p, True)
        if path in _made:
            _made.remove(path)


def sweep(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collectors find that no plan needs them; asks them to look, after a large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables made inside, except those that the block took before it: for steps whose result is written there."""
    before = len(_made)
    yield
    discard(spark, _made[before:])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def utf8_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

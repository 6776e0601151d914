"""Keyed state over streams: exactly-once keys, windowed counts, snapshot differences, capped logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def exactly_once(stream: DataFrame, key: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; later ones are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, at: str, keys: list[str], length: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Counts by tumbling window and keys; late rows within the delay still count."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


LIFECYCLE = "pr_key string, iteration int, finding string, status string"


def lifecycle(stream: DataFrame, keep_days: float = 30) -> DataFrame:
    """stream: pr_key, iteration, finding. Against each key's last snapshot: persisted, new and resolved findings.

    A micro-batch may hold several iterations of a key; they are compared in order. State is one snapshot for each key,
    which goes keep_days after the key's last rows; a key that comes back later starts anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        last = set(state.get[0]) if state.exists else None
        for iteration, part in rows.sort_values("iteration").groupby("iteration"):
            now = set(part["finding"])
            before = last or set()
            out = [(f, "persisted" if f in before else "new") for f in sorted(now)] + [(f, "resolved") for f in sorted(before - now)]
            yield pd.DataFrame([(key[0], int(iteration), f, s) for f, s in out], columns=["pr_key", "iteration", "finding", "status"])
            last = now
        state.update((sorted(last),))
        state.setTimeoutDuration(int(keep_days * 86_400_000))

    return stream.groupBy("pr_key").applyInPandasWithState(step, LIFECYCLE, "findings array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_batches(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str, buckets: int = 64):
    """A query that keeps under path the latest row of each key; read it with `read_merged`.

    Keys are dealt over buckets, and a micro-batch writes anew only those that it touches, under path/data/batch=N. A
    list of `buckets` rows, path/lists/batch=N, says which batch holds each bucket's rows. A batch that is run again
    writes the same again. What the last two lists don't name is deleted.
    """
    from heddle.operators.frames import latest

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        held = _list_of(spark, path, n - 1)
        touched = {r[0] for r in batch.select("bucket").distinct().collect()}  # `buckets` numbers at most
        rows = batch
        for old in {held[b] for b in touched if b in held}:
            rows = rows.unionByName(_bucket_rows(spark, path, old, [b for b in touched if held.get(b) == old], batch.schema))
        if touched:
            latest(rows, ["bucket", *key], order).select(*batch.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={n}")
        now = held | dict.fromkeys(touched, n)
        spark.createDataFrame(sorted(now.items()), "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/batch={n}")
        batch.unpersist()
        for old in set(_list_of(spark, path, n - 2).values()) - set(held.values()) - set(now.values()):
            _delete(spark, f"{path}/data/batch={old}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _files(spark, path)
    files.delete(p, True)


def _list_of(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """Which batch holds each bucket as of batch n, or of the last one before it that wrote a list."""
    files, p = _files(spark, f"{path}/lists")
    done = [int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(p)] if files.exists(p) else []
    seen = max((k for k in done if k <= n), default=None)
    return {} if seen is None else {r["bucket"]: r["held"] for r in spark.read.parquet(f"{path}/lists/batch={seen}").collect()}


def _bucket_rows(spark: SparkSession, path: str, n: int, some: list[int], schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/data/batch={n}").parquet(f"{path}/data/batch={n}").where(F.col("bucket").isin(some))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `merge_batches` holds after its last batch."""
    held = _list_of(spark, path, 1 << 62)
    out = None
    for n in sorted(set(held.values())):
        schema = spark.read.parquet(f"{path}/data/batch={n}").schema
        part = _bucket_rows(spark, path, n, [b for b, at in held.items() if at == n], schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"nothing has been written under {path}")
    return out.drop("bucket")

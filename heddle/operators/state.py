"""Keyed state in batch form: idempotent delivery, TTL cache, deltas, capped logs, counters. Streaming forms: heddle.streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.relate import first_wins


def idempotent(batch: DataFrame, seen: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch whose key was neither seen before nor earlier in the batch."""
    return first_wins(batch.join(seen.select(*key).distinct(), key, "left_anti"), key, order)


def cache_plan(files: DataFrame, cache: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """files: file, content_hash; cache: file, content_hash, reviewed_at. Adds hit, stale or miss."""
    c = cache.groupBy("file", "content_hash").agg(F.max("reviewed_at").alias("reviewed_at"))
    fresh = F.col("reviewed_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return files.join(c, ["file", "content_hash"], "left").withColumn("plan", F.when(F.col("reviewed_at").isNull(), "miss").when(fresh, "hit").otherwise("stale")).drop("reviewed_at")


def evict(log: DataFrame, order: list, capacity: int, keys: list[str] | None = None) -> DataFrame:
    """The first `capacity` rows of a log in the given order, for each key if keys are given."""
    if not keys:
        return log.orderBy(*order).limit(capacity)
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("__hd_n", F.row_number().over(w)).where(F.col("__hd_n") <= capacity).drop("__hd_n")


def expire(log: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    return log.where(F.col(at) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def count_hits(memories: DataFrame, hits: DataFrame, as_of: str) -> DataFrame:
    """memories: id, hit_count, last_hit_at; hits: id. Adds each id's hits and sets the time of those with any."""
    h = hits.groupBy("id").agg(F.count(F.lit(1)).alias("__hd_n"))
    return memories.join(h, "id", "left").withColumns(
        {"hit_count": F.col("hit_count") + F.coalesce("__hd_n", F.lit(0)), "last_hit_at": F.when(F.col("__hd_n") > 0, F.lit(as_of).cast("timestamp")).otherwise(F.col("last_hit_at"))}
    ).drop("__hd_n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE by key, then INSERT."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT where no stored row has the same keys."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti"))


def delta_savings(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous, current: file, content_hash, tokens. Files and tokens that an incremental run leaves out, in percent."""
    same = current.join(previous.select("file", "content_hash").distinct(), ["file", "content_hash"], "left_semi").agg(F.count(F.lit(1)).alias("same"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("same_tokens"))
    every = current.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    pct = lambda a, b: F.coalesce(F.floor(F.col(a) * 100 / F.nullif(F.col(b), F.lit(0)) + 0.5), F.lit(0)).cast("int")
    return every.crossJoin(same).select("files", "same", pct("same", "files").alias("files_saved"), pct("same_tokens", "tokens").alias("tokens_saved"))


def fold_status(checks: DataFrame, key: list[str]) -> DataFrame:
    """checks: state success, failure, pending. failed before pending before passed; without checks no_checks."""
    return checks.groupBy(*key).agg(F.when(F.bool_or(F.col("state") == "failure"), "failed").when(F.bool_or(F.col("state") == "pending"), "pending").when(F.count("state") > 0, "passed").otherwise("no_checks").alias("status"))


def budget_chunks(rows: DataFrame, key: str, order: str, budget: int, width: int = 4096) -> DataFrame:
    """rows: key, order (an integer, distinct within a key), tokens. Adds `chunk`: how many budgets the rows before fill.

    Totals are run in two levels, over ranges of `width` order values and inside them, so that a large key is many tasks.
    """
    part = F.floor(F.col(order) / width).alias("__hd_part")
    rows = rows.select("*", part)
    ranges = rows.groupBy(key, "__hd_part").agg(F.sum("tokens").alias("n"))
    above = Window.partitionBy(key).orderBy("__hd_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = ranges.select(F.col(key).alias("__hd_k"), F.col("__hd_part").alias("__hd_p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__hd_base"))
    within = Window.partitionBy(key, "__hd_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("__hd_run", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    joined = run.join(base, F.col(key).eqNullSafe(F.col("__hd_k")) & F.col("__hd_part").eqNullSafe(F.col("__hd_p")))
    return joined.withColumn("chunk", F.floor((F.col("__hd_base") + F.col("__hd_run")) / budget)).drop("__hd_part", "__hd_p", "__hd_k", "__hd_base", "__hd_run")

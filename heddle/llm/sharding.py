"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every row belongs to one of P logical partitions (a seeded hash of its content). How many rows of each partition
go to each shard is drawn exactly: row by row of the P x shards matrix, a multivariate hypergeometric draw from the
capacities that are left. Rows are permuted inside their partition, dealt out by the matrix, and permuted again
inside their shard. Only the partition counts and the matrix reach the driver; both are bounded by MAX_PARTITIONS.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise, utf8_bytes

#: Bounds the matrix: at most so many logical partitions, whatever the input.
MAX_PARTITIONS = 16384
ROWS_A_PARTITION = 20_000


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts: rows of each partition. Returns partitions x shards, with row sums `counts` and column sums at most one apart."""
    total = int(counts.sum())
    left = np.full(shards, total // shards, dtype=np.int64)
    left[: total % shards] += 1
    rng = np.random.Generator(np.random.PCG64(seed))
    rng.shuffle(left)
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        if left.sum() == n:
            matrix[p] = left
        else:
            # NumPy bounds `marginals` by 10^9 items in all.
            matrix[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() < 10**9 else _draw(rng, left, int(n))
        left = left - matrix[p]
    return matrix


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Shard by shard, where NumPy's sampler refuses 10^9 items or more; each take follows the hypergeometric law."""
    out, rest = np.zeros_like(left), int(left.sum())
    for i, have in enumerate(left.tolist()):
        if n == 0:
            break
        rest -= have
        out[i] = int(rng.hypergeometric(have, rest, n)) if have + rest < 10**9 else hypergeometric(rng, have, rest, n)
        n -= int(out[i])
    return out


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n / n) / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    d = (x - mean) / mean
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x if x else mean
    total, power, k = d * d / 2, d * d, 2
    while True:  # the series of (1 + d) log(1 + d) - d
        power, k = -power * d, k + 1
        more = total + power / (k * (k - 1))
        if more == total:
            return mean * total
        total = more


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Saddle-point form of the binomial law's logarithm, which keeps its digits at any size."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log1p(-q)) if min(p, q) > 0 else 0.0
    small = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return small - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hypergeometric(k: int, good: int, bad: int, n: int) -> float:
    """Logarithm of the chance of k good ones among n drawn without replacement."""
    if k < max(0, n - bad) or k > min(n, good):
        return -math.inf
    if n in (0, good + bad):
        return 0.0
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    return _log_binomial(k, good, p, q) + _log_binomial(n - k, bad, p, q) - _log_binomial(n, good + bad, p, q)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw from the hypergeometric law by rejection, at any size: no limit law is put in its place.

    The law is log-concave, so its chances a distance d from its mode are at most c min(1, exp(1 - c d)) with c the
    mode's own (a universal bound); candidates from that hat are accepted by the law's chances, to double precision.
    """
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), n - bad, 0), n, good)
    top = log_hypergeometric(mode, good, bad, n)
    c = math.exp(top) * (1 - 1e-9)
    w = 1 + c / 2
    while True:
        u, v, height = rng.random(), 1 - rng.random(), 1 - rng.random()
        y = v * w / c if u <= w / (1 + w) else (w - math.log(v)) / c
        k = mode + (round(y) if rng.random() < 0.5 else -round(y))
        if math.log(height) + min(0.0, w - c * y) <= log_hypergeometric(k, good, bad, n) - top:
            return k


def shard_rows(df: DataFrame, key: list[str], shards: int = 16, seed: int = 20240101) -> DataFrame:
    """Adds `shard` int and `slot` long (gapless from 0 in each shard) to the rows of df.

    key: columns whose content seeds the permutations. Shard sizes differ by one row at most. Rows that are equal in
    all key columns may change places with each other, which shows in nothing but those equal rows. Nulls hash like a
    value of their own. An empty input gives an empty result. Columns of df keep their names; helper columns start
    with `__hd_` and are dropped. Callers pass a narrow frame; rows are moved twice.
    """
    spark = df.sparkSession
    h = lambda k: F.xxhash64(F.lit(seed + k), *[F.col(c) for c in key])
    base = materialise(df.withColumns({"__hd_a": h(1), "__hd_b": h(2)}), "shard-keys")
    rows = base.count()
    partitions = min(MAX_PARTITIONS, max(64, math.ceil(rows / ROWS_A_PARTITION)))
    base = base.withColumn("__hd_p", F.pmod("__hd_a", F.lit(partitions)).cast("int"))
    counts = np.zeros(partitions, dtype=np.int64)
    for r in base.groupBy("__hd_p").count().collect():  # at most MAX_PARTITIONS rows
        counts[r[0]] = r[1]
    ends = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    matrix = spark.createDataFrame([(p, e) for p, e in enumerate(ends.tolist())], "__hd_p int, __hd_ends array<bigint>")
    within = Window.partitionBy("__hd_p").orderBy("__hd_a", "__hd_b", *key)
    dealt = (
        base.withColumn("__hd_r", F.row_number().over(within) - 1)
        .join(F.broadcast(matrix), "__hd_p")  # MAX_PARTITIONS x shards longs at most
        .withColumn("shard", F.expr("size(filter(__hd_ends, e -> e <= __hd_r))"))
    )
    # A shard is ordered in so many parts, of an eighth of ROWS_A_PARTITION rows or more; 2^16 of them from 40 billion rows on.
    bits = min(max(4, math.ceil(math.log2(max(rows, 1) / shards / ROWS_A_PARTITION + 1)) + 2), 16)
    dealt = dealt.withColumn("__hd_sub", F.shiftrightunsigned("__hd_b", 64 - bits).cast("int")).drop("__hd_r", "__hd_ends")
    before = Window.partitionBy("shard").orderBy("__hd_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__hd_sub").count().select("shard", "__hd_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__hd_start"))
    slots = Window.partitionBy("shard", "__hd_sub").orderBy("__hd_b", "__hd_a", *key)
    return (
        dealt.withColumn("__hd_n", F.row_number().over(slots) - 1)
        .join(F.broadcast(starts), ["shard", "__hd_sub"])  # shards x 2^16 rows at most
        .withColumn("slot", (F.col("__hd_start") + F.col("__hd_n")).cast("long"))
        .select(*df.columns, "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, key: list[str], shards: int = 16, seed: int = 20240101) -> None:
    """Writes whole rows as one folder for each shard, in slot order."""
    out = shard_rows(df, key, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 20240101) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents; a null text has no bytes (size 1, CRC 0)."""
    body = utf8_bytes(F.col("text"))
    narrow = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

"""Packing by minimum bin slack: documents become sequences of at most `capacity` tokens with little padding.

A document is cut into full sequences and a rest shorter than one. How many rests there are of each length is all the
planner needs: a window starts with the longest length that is left, a bitset subset-sum programme over the other
lengths finds the multiset that fills it closest to capacity, its counts are read back from the stored bitsets, and
the window is repeated for as long as the counts last. So planning depends on the capacity and not on the number of
documents. Rests are numbered inside their length by two levels of counting and looked up in the plan.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.tokens import encoder, slices

CAPACITY = 1024
#: Bounds the counts that the driver sees: capacity x MAX_BUCKETS numbers.
MAX_BUCKETS, ROWS_A_BUCKET = 512, 20_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset within `counts` whose sum comes closest to `room` from below, as length -> uses."""
    full, reach, steps = 1 << room, 1, []
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, 2 * k
        if reach & full:
            break
    at, uses = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:  # only with this step
            at -= length * k
            uses[length] = uses.get(length, 0) + k
    return uses


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(uses, repeats) of each kind of window until no length is left."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        seed = max(left)
        others = dict(left)
        others[seed] -= 1
        uses = fill(others, capacity - seed)
        uses[seed] = uses.get(seed, 0) + 1
        repeats = min(left[n] // u for n, u in uses.items())
        out.append((uses, repeats))
        for n, u in uses.items():
            left[n] -= u * repeats
            if not left[n]:
                del left[n]
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, n_tokens, crcs: CRC-32 of each piece of `capacity` ids and of the rest, for whole texts with end_id appended."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, ends = library.encode(part.column("text"), end_id)
                sizes = np.diff(ends)
                pieces = -(-sizes // capacity)
                last = np.cumsum(pieces)
                nth = np.arange(last[-1]) - np.repeat(last - pieces, pieces)
                start = np.repeat(ends[:-1], pieces) + nth * capacity
                stop = np.minimum(start + capacity, np.repeat(ends[1:], pieces))
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]), pa.int32()), pa.array(crcs, pa.int64()))
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes), lists], ["doc_id", "n_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digest, "doc_id bigint, n_tokens bigint, crcs array<bigint>")


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """lengths: doc_id long, n_tokens long, crcs array<long> (one for each piece). One row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences are numbered from 0, those
    made of rests first. Rows that repeat, and rows with a null doc_id, are documents of their own. Documents of no
    tokens (which `token_pieces` never makes) and empty tables give no rows.
    """
    rows = materialise(lengths.withColumn("__hd_row", F.monotonically_increasing_id()), "pack-lengths")
    buckets = min(MAX_BUCKETS, max(64, math.ceil(rows.count() / ROWS_A_BUCKET)))
    rows = rows.select(
        "doc_id", "n_tokens", "crcs", "__hd_row", F.pmod(F.xxhash64("__hd_row"), F.lit(buckets)).cast("int").alias("b"), (F.col("n_tokens") % capacity).cast("int").alias("rest"), F.floor(F.col("n_tokens") / capacity).alias("full")
    )
    found = rows.groupBy("rest", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()  # capacity x MAX_BUCKETS rows at most
    rests, fulls = np.zeros((capacity, buckets), dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for r in found:
        rests[r["rest"], r["b"]] = r["n"]
        fulls[r["b"]] += r["full"]
    windows = plan({n: int(c) for n, c in enumerate(rests.sum(axis=1)) if n and c}, capacity)
    first_full = sum(repeats for _, repeats in windows)
    full_base = first_full + np.cumsum(fulls) - fulls
    rank_base = np.cumsum(rests, axis=1) - rests
    keys, uses_at, seq_at, off_at = _table(windows)

    by_bucket = Window.partitionBy("b").orderBy("__hd_row")
    by_rest = Window.partitionBy("b", "rest").orderBy("__hd_row")
    before = F.coalesce(F.sum("full").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.repartition("b").select("doc_id", "n_tokens", "crcs", "b", "rest", "full", before.alias("before"), (F.row_number().over(by_rest) - 1).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, b, rest, full, at, rank = (np.asarray(batch.column(c)) for c in ("n_tokens", "b", "rest", "full", "before", "rank"))
            pieces = full + (rest > 0)
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            last = k == full[row]
            length = np.where(last, rest[row], capacity)
            sequence, offset = full_base[b[row]] + at[row] + k, np.zeros(len(row), dtype=np.int64)
            if last.any():
                r = row[last]
                nth = rank[r] + rank_base[rest[r], b[r]]
                j = np.searchsorted(keys, (rest[r].astype(np.int64) << 48) | nth, "right") - 1
                nth = nth - (keys[j] & ((1 << 48) - 1))
                sequence[last] = seq_at[j] + nth // uses_at[j]
                offset[last] = off_at[j] + nth % uses_at[j] * rest[r]
            crcs = batch.column("crcs")
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(row)), pa.array(k * capacity), pa.array(length.astype(np.int64)), crcs.flatten(), pa.array(n[row]), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _table(windows: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For ranges of a length's numbers: key (length, first number), uses in a window, first sequence, first offset."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for uses, repeats in windows:
        offset = 0
        for n in sorted(uses, reverse=True):
            out.append(((n << 48) | seen.get(n, 0), uses[n], sequence, offset))
            seen[n] = seen.get(n, 0) + uses[n] * repeats
            offset += n * uses[n]
        sequence += repeats
    a = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises whole texts (null: empty) of docs and packs them; see `pack`."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)

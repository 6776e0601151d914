"""Benchmark decontamination by spaced seeds.

A mask ignores some positions of a window of tokens, so a hash of the others survives substitutions at those
positions. Windows of the benchmark are hashed under each mask; a Bloom filter of bounded size lets the scan of the
documents keep only windows that may be among them; what is kept is joined by hash, and each pair of places is
verified by counting equal tokens along its diagonal in the benchmark item.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.tokens import slices

TOKEN = re.compile(r"\w+")
#: 1: the position counts. Shorter items, down to LEAST tokens, are looked for as a whole (see `masks_for`).
MASKS = ("1101100101", "1110100011", "1011000111")
LEAST = 5
#: Verified: a stretch of WINDOW tokens (the whole item if it is shorter) with this share of equal tokens.
WINDOW, IDENTITY = 20, 0.8
#: Tokens kept on each side of a hit; beyond this a region never matters to a window around the hit.
PAD = 24
#: The filter: bits for each window of the benchmark, probes, and a bound on all bits (16 MB), whatever the benchmark.
BITS_A_WINDOW, PROBES, MAX_BITS = 64, 3, 1 << 27
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class _Hashes(dict):
    """Token -> 64-bit hash, bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_known = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text."""
    found = TOKEN.findall((text or "").lower())
    return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))


def masks_for(length: int) -> tuple[str, ...]:
    """Masks of short items of a length: as many tokens may differ as IDENTITY allows, one at most, wherever it is."""
    if length - math.ceil(IDENTITY * length - 1e-9) == 0:
        return ("1" * length,)
    return tuple("1" * i + "0" + "1" * (length - i - 1) for i in range(length))


def seeds(t: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[tuple[int, np.ndarray]]:
    """For each mask its span and the hash at every start."""
    out = []
    for mask in masks:
        at, span = [i for i, c in enumerate(mask) if c == "1"], len(mask)
        n = max(0, len(t) - span + 1)
        h = np.full(n, int("1" + mask, 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
        for k, a in enumerate(at):
            h = (h ^ t[a : a + n]) * ODD[k % len(ODD)]
            h ^= h >> np.uint64(29)
        out.append((span, h))
    return out


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def _by_hash(h: np.ndarray, at: np.ndarray) -> list[dict]:
    """Each distinct hash once, with all places where it stands."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return [{"h": x, "at": a.tolist()} for x, a in zip(h[first].tolist(), np.split(at, first[1:]), strict=True)] if len(first) else []


HITS = "array<struct<h:bigint,at:array<int>>>"
_HIT_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.list_(pa.int32()))]))


def index_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(item, item_id, n, tokens) of each item with enough tokens; (h, item, at) of its windows, each hash once; the masks in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = [tokens(x) for x in part.column("text").to_pylist()]
                s = []
                for x in t:
                    found = seeds(x, MASKS if len(x) >= len(MASKS[0]) else masks_for(len(x)) if len(x) >= LEAST else ())
                    h = np.concatenate([np.zeros(0, np.uint64), *(hs for _, hs in found)]).view(np.int64)
                    s.append(_by_hash(h, np.concatenate([np.zeros(0, np.int64), *(np.arange(len(hs)) for _, hs in found)]).astype(np.int64)))
                yield pa.record_batch([part.column("item_id"), pa.array([len(x) for x in t], pa.int32()), pa.array([x.tobytes() for x in t], pa.binary()), pa.array(s, _HIT_TYPE)], ["item_id", "n", "tokens", "windows"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialise(items.mapInArrow(run, f"item_id bigint, n int, tokens binary, windows {HITS}").where("size(windows) > 0").withColumn("item", F.monotonically_increasing_id()), "bench-items")
    windows = items.select("item", F.explode("windows").alias("w")).select(F.col("w.h").alias("h"), "item", F.col("w.at").alias("at"))
    short = sorted(r[0] for r in items.where(F.col("n") < len(MASKS[0])).select("n").distinct().collect())  # 5 lengths at most
    masks = MASKS + tuple(m for n in short for m in masks_for(n))
    return items.select("item", "item_id", "n", "tokens"), materialise(windows, "bench-windows"), masks


def bloom(windows: DataFrame) -> np.ndarray:
    """The bit set of the windows' hashes as 64-bit words; MAX_BITS / 64 rows reach the driver at most."""
    n = windows.count()
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, math.ceil(math.log2(max(1, n) * BITS_A_WINDOW))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(np.asarray(batch.column("h")).view(np.uint64), bits))) if batch.num_rows else np.zeros(0, np.uint64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.record_batch([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = windows.select("h").mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # 16 bytes a row
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bit")).view(np.uint64)
    return out


def find_regions(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, first (token offset), tokens, hits array of (h, places): stretches of documents around windows that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        size = 64 * len(table)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    t = tokens(text)
                    at, hs = [], []
                    for _, h in seeds(t, masks):
                        ok = np.ones(len(h), dtype=bool)
                        for p in _probes(h, size):
                            ok &= (table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                        i = np.flatnonzero(ok)
                        at.append(i)
                        hs.append(h[i])
                    where = np.concatenate(at)
                    if not len(where):
                        continue
                    h = np.concatenate(hs).view(np.int64)
                    order = np.argsort(where, kind="stable")
                    where, h = where[order], h[order]
                    for a, b in _regions(where):
                        lo, hi = max(0, int(where[a]) - PAD), min(len(t), int(where[b - 1]) + len(MASKS[0]) + PAD)
                        rows.append((doc, lo, t[lo:hi].tobytes(), _by_hash(h[a:b], where[a:b] - lo)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.binary(), _HIT_TYPE]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["doc_id", "first", "tokens", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, first bigint, tokens binary, hits {HITS}")


def _regions(where: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(where) > 2 * PAD) + 1
    edges = [0, *cut.tolist(), len(where)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def best_window(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Along b[i] = a[i + shift]: most equal tokens in a stretch of `window` tokens, that stretch's start in a, and `window`."""
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    window = min(WINDOW, len(b))
    if hi - lo < window:
        return 0, 0, window
    sums = np.concatenate([[0], np.cumsum(a[lo + shift : hi + shift] == b[lo:hi])])
    runs = sums[window:] - sums[:-window]
    i = int(np.argmax(runs))
    return int(runs[i]), lo + shift + i, window


def shifts(places: list[dict], size: int, length: int) -> np.ndarray:
    """The diagonals on which a region of `size` tokens and an item of `length` share a hash, each once."""
    seen = np.zeros(size + length + 1, dtype=bool)
    for x in places:
        here, at = np.array(x["here"], np.int64), np.array(x["at"], np.int64)
        few, many, sign = (here, at, -1) if len(here) < len(at) else (at, here, 1)
        for p in few.tolist():
            seen[sign * (many - p) + length] = True
    return np.flatnonzero(seen) - length


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, item_id, at, equal, window: one row for each pair that is verified.

    `at` is the token offset of the best stretch in the document, `equal` of its `window` tokens agree with the item.
    Tokens are runs of word characters, lower-cased. Items of fewer than LEAST tokens hold too little to be told from
    ordinary text; they, null texts and texts without tokens take no part. Rows that repeat give one row for each
    doc_id and item_id; a null id is an id. Empty tables give no rows. No hit is dropped: what passes the filter
    wrongly fails the join or the verification. A hash is joined once for each region and item, however often it
    stands in either, so a text of one repeated word is no more rows than another.
    """
    items, windows, masks = index_items(benchmark)
    regions = materialise(find_regions(docs, bloom(windows), masks).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode("hits").alias("x")).select("region", F.col("x.h").alias("h"), F.col("x.at").alias("here"))
    met = hits.join(windows, "h").groupBy("region", "item").agg(F.collect_list(F.struct("here", "at")).alias("places"))  # bounded by the region's and the item's lengths
    pairs = met.join(regions.select("region", "doc_id", "first", F.col("tokens").alias("a")), "region").join(items.select("item", "item_id", F.col("tokens").alias("b")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for x, y, places in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "places")), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # The most equal tokens, then the first place.
                got.append(max((best_window(a, b, int(s)) for s in shifts(places, len(a), len(b))), key=lambda r: (r[0], -r[1])))
            equal, at, window = (np.array(x, dtype=np.int64) for x in (zip(*got, strict=True) if got else ((), (), ())))
            out = pa.record_batch(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(np.asarray(batch.column("first")) + at), pa.array(equal), pa.array(window)], ["doc_id", "item_id", "at", "equal", "window"]
            )
            yield out.filter(pa.array(equal >= np.ceil(IDENTITY * window - 1e-9)))

    found = pairs.select("doc_id", "item_id", "first", "a", "b", "places").mapInArrow(verify, "doc_id bigint, item_id bigint, at bigint, equal bigint, window bigint")
    best = F.max_by(F.struct("at", "equal", "window"), F.struct(F.col("equal") / F.col("window"), "window", -F.col("at"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.at", "best.equal", "best.window")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified pair; all columns stay, and so do rows with a null doc_id."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__hd_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == F.col("__hd_bad"), "left_anti")

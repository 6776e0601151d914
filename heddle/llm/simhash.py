"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance, then components.

Fingerprints within d bits of each other agree on at least B - d of B blocks, so each fingerprint is filed under every
choice of B - d blocks and only those filed together are compared. Equal fingerprints are one node. Inside a file a
search that shrinks the unvisited set yields a spanning forest of the links, not all pairs, so that a large group of
near copies costs about as much as its size.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.components import connected_components
from heddle.llm.tokens import slices

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Files of this size or less are compared by shifted rows; larger ones by the shrinking search.
SMALL_FILE = 32
#: Texts of fewer words are described by their whole sequence, not by their vocabulary.
LEAST_VOCABULARY = 10


def fingerprint(text: bytes, words: int = 4) -> int:
    """Unsigned 64 bits; a bit is set if it is set in over half the shingles' XXH64. No words: 0.

    words = 0 takes the distinct words instead of shingles, so that one changed word is one feature and not several.
    """
    import xxhash

    h = xxhash.xxh64_intdigest
    found = WORD.findall(text.lower())  # bytes.lower changes A-Z alone
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words or not words and len(found) < LEAST_VOCABULARY:
        hashes = [h(line, SEED)]
    elif not words:
        hashes = [h(w, SEED) for w in set(found)]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [h(line[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(t or b"", words) for t in texts], dtype=np.uint64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def block_masks(distance: int, nodes: int) -> list[int]:
    """One mask for each choice of blocks; more and finer blocks for more nodes, so that files stay small."""
    extra = 2 if nodes < 1 << 22 else 3 if nodes < 1 << 29 else 4
    blocks = distance + extra
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(parts, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span every component of one file; each fingerprint is taken from the unvisited once."""
    a, b, left = [], [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    return a, b


def _file_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            a, b = [], []
            for s, n in zip(first[size > SMALL_FILE].tolist(), size[size > SMALL_FILE].tolist(), strict=True):
                x, y = _forest(fp[s : s + n], distance)
                a += x
                b += y
            small = np.repeat(size <= SMALL_FILE, size)
            k, f = key[small], fp[small]
            for step in range(1, SMALL_FILE):
                k1, f1 = k[step:], f[step:]
                same = k1 == k[: len(k1)]
                if not same.any():
                    break
                near = same & (np.bitwise_count(f[: len(f1)] ^ f1) <= distance)
                a.append(f[: len(f1)][near])
                b.append(f1[near])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last file, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            if held and key[-1] == held[0][0][0]:
                held.append((key, fp))
                continue
            start = int(np.searchsorted(key, key[-1]))
            held.append((key[:start], fp[:start]))
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(key[start:], fp[start:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def link_fingerprints(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """nodes: fp (distinct longs). Links a, b that connect exactly what chains of pairs within `distance` bits connect.

    A file's key is a hash of the chosen blocks' number and bits; two files whose keys collide are searched as one,
    which only adds comparisons.
    """
    masks = block_masks(distance, nodes.count())
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    filed = nodes.select("fp", F.explode(keys).alias("key"))
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_file_links(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """docs: doc_id, text (other columns are not read). Returns doc_id, fp, component_id for every row.

    component_id is the smallest doc_id in the row's component, null if all of them are null. Texts without words
    (null, empty, only separators) have fingerprint 0, linked like any other. Texts of fewer words than a shingle are
    one shingle. Rows that repeat stay. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, words), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(link_fingerprints(nodes.select("fp"), distance))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-roots")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")  # so that both sides are plain scans and a large component is split
    named = materialise(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 0, distance: int = 6) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component; all columns stay. Rows without doc_id stay too.

    Two texts are linked if 0.8 or more of their five-word shingles agree; texts of fewer words are one shingle. All such
    pairs count, and none is taken on a fingerprint's word: `words` and `distance` say which pairs are looked at first
    (see `shingles`). Where rows share a doc_id, they stay if one of them heads its component.
    """
    from heddle.llm.shingles import near_copies

    seen = near_copies(docs, words, distance).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("head"))
    gone = materialise(seen.where("doc_id is not null and not head").select(F.col("doc_id").alias("__hd_gone")), "simhash-gone")
    return docs.join(gone, docs["doc_id"] == F.col("__hd_gone"), "left_anti")

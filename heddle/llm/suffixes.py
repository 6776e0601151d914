"""Removal of byte strings of a threshold length that start in an earlier document, by depth-limited radix passes.

Sorting suffixes only through `length` bytes puts equal windows of that length together; that is done here digit by
digit, and what is alone after a digit is dropped. The first digit is not the leading bytes but one that few suffixes
need: each window is filed under the 16-byte string inside it whose hash is least (the leftmost of equal ones), so
equal windows are filed together, and a run of windows with the same place is one segment. Inside a file the digits of
eight bytes follow from the most significant on; groups are told by equality, so the order of different groups, which
nothing here needs, is that of a hash and not of bytes.

1. Documents are gathered into blobs of bounded size (a table).
2. First digit: each blob sends the distinct hashes of its segments, by buckets of the hash; a bucket answers each
   blob with one bit for each, whether another document has it too.
3. Further digits: segments with a set bit send their bytes, each distinct content once a blob; a bucket orders the
   windows by digits of eight bytes and answers with the smallest doc_id of each window that has a smaller one.
4. Each blob marks the bytes of its windows that start in a smaller doc_id.

A blob sends a content once, however often it holds it, so a passage that a third of all documents share is no more
than one message from each blob. Long texts are worked through in chunks; a window never leaves its document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.tokens import slices

LENGTH = 50
#: Bytes of the first digit.
ANCHOR = 16
BLOB_BYTES, CHUNK = 2 << 20, 1 << 18
#: Windows of a bucket on average, if all repeat: bounds what a task holds at about a hundred bytes each.
WINDOWS_A_BUCKET = 5_000_000
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * C1
    x ^= x >> np.uint64(32)
    x *= C2
    x ^= x >> np.uint64(29)
    return x


def _words(buffer, shape: tuple[int, ...], strides: tuple[int, ...]) -> np.ndarray:
    """The eight bytes from each position as an integer."""
    return np.ndarray(shape, "<u8", buffer, strides=strides)


@dataclass
class Segments:
    """Runs of windows of a blob: key, row (document of the blob), first window and anchor (offsets in the blob), count."""

    key: np.ndarray
    row: np.ndarray
    first: np.ndarray
    anchor: np.ndarray
    count: np.ndarray


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each start the offset of the least of `width` values from there, the leftmost of equal ones."""
    v, at, w = h, np.arange(len(h), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        less = v[step:] < v[:-step]
        v, at, w = np.where(less, v[step:], v[:-step]), np.where(less, at[step:], at[:-step]), w + step
    return at


def segments(data: bytes, sizes: np.ndarray, length: int) -> Segments:
    """data: the documents' bytes one after the other; sizes: bytes of each."""
    parts: list[tuple[np.ndarray, ...]] = []
    padded = data + bytes(ANCHOR)
    starts = np.cumsum(sizes) - sizes
    windows = np.maximum(0, sizes - length + 1)
    spans, group, used = [], [], 0  # stretches of neighbouring documents, or of one long document, of about CHUNK windows
    for r in np.flatnonzero(windows).tolist():
        for a in range(0, int(windows[r]), CHUNK):
            n = min(CHUNK, int(windows[r]) - a)
            if used + n > CHUNK and group:
                spans.append(group)
                group, used = [], 0
            group.append((r, int(starts[r]) + a, n))
            used += n
    if group:
        spans.append(group)
    for group in spans:
        lo, hi = group[0][1], group[-1][1] + group[-1][2] + length - 1
        n = hi - lo - ANCHOR + 1
        x = _words(memoryview(padded)[lo:], (n + 8,), (1,))
        h = _mix(_mix(x[:n]) ^ x[8:])
        least = _leftmost_least(h, length - ANCHOR + 1)
        count = np.array([g[2] for g in group])
        row = np.repeat([g[0] for g in group], count)
        at = np.repeat([g[1] - lo for g in group], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        a = least[at].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
        # The least of many hashes is small; hashed again, keys spread evenly over buckets.
        parts.append((_mix(h[a[new]] ^ C3), row[new], at[new] + lo, a[new] + lo, np.diff(np.concatenate([new, [len(a)]]))))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Segments(none.astype(np.uint64), none, none, none, none)
    return Segments(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


@dataclass(frozen=True)
class Spec:
    """What all steps share: the window's length, buckets, and the bits of a hash that the first digit compares."""

    length: int
    buckets: int
    bits: int

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def digit(self, key: np.ndarray) -> np.ndarray:
        return key >> np.uint64(64 - self.bits)


def make_blobs(docs: DataFrame, carry: bool = False) -> DataFrame:
    """blob, ids array, sizes array, data (compressed bytes), rest: documents in bounded groups; null texts are empty.

    rest holds all columns of the documents as an Arrow stream if carry is set, and is null otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=6)
        ids, texts, rest, used = [], [], [], 0

        def blob() -> pa.RecordBatch:
            body = None
            if carry:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest[0].schema) as stream:
                    for x in rest:
                        stream.write_batch(x)
                body = small.compress(sink.getvalue().to_pybytes())
            cols = [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([small.compress(b"".join(texts))], pa.binary()), pa.array([body], pa.binary())]
            return pa.record_batch(cols, ["ids", "sizes", "data", "rest"])

        for batch in batches:
            for part in slices(batch, "text", BLOB_BYTES // 4):
                new = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                more = sum(map(len, new))
                if ids and (used + more > BLOB_BYTES or len(ids) + len(new) > 1 << 16):
                    yield blob()
                    ids, texts, rest, used = [], [], [], 0
                ids += part.column("doc_id").cast(pa.int64()).to_pylist()
                texts += new
                rest += [part.drop_columns(["text"])] if carry else []
                used += more
        if ids:
            yield blob()

    rows = docs if carry else docs.select("doc_id", "text")
    return materialise(rows.mapInArrow(run, "ids array<bigint>, sizes array<bigint>, data binary, rest binary").withColumn("blob", F.monotonically_increasing_id()), "blobs")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, since a blob's row is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Blob:
    def __init__(self, ids: list[int | None], sizes: list[int], data: bytes, spec: Spec):
        self.ids, self.sizes = ids, np.array(sizes, dtype=np.int64)
        self.data = _expand(data)
        # A document without an id takes no part: it has no windows.
        active = np.where(np.array([i is None for i in ids], dtype=bool), 0, self.sizes)
        if (active == self.sizes).all():
            self.seg = segments(self.data, self.sizes, spec.length)
        else:
            self.seg = segments(self.data, self.sizes, spec.length)
            keep = active[self.seg.row] > 0
            self.seg = Segments(*(getattr(self.seg, f)[keep] for f in ("key", "row", "first", "anchor", "count")))
        self.doc = np.array([i or 0 for i in ids], dtype=np.int64)[self.seg.row] if len(ids) else np.zeros(0, np.int64)
        self.spec = spec

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digits in ascending order, the bucket and `several documents here` of each, and each segment's number."""
        digit = self.spec.digit(self.seg.key)
        order = np.argsort(digit, kind="stable")
        d = digit[order]
        new = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
        number = np.empty(len(d), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if not len(first):
            return d, np.zeros(0, np.int64), np.zeros(0, bool), number
        doc = self.doc[order]
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        return d[first], self.spec.bucket(d[first] << np.uint64(64 - self.spec.bits)), several, number

    def shared(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Which segments another document has too, by the buckets' bits."""
        d, bucket, _, number = self.keys()
        bits = np.zeros(len(d), dtype=bool)
        for b, mask in answers:
            lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
            bits[lo:hi] = np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo)
        return bits[number]

    def items(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct contents among the shared segments: rows of bytes with the anchor in one column, left, count, least doc_id; and segments, item of each."""
        width = self.spec.length - ANCHOR
        at = np.flatnonzero(shared)
        left, count = self.seg.anchor[at] - self.seg.first[at], self.seg.count[at]
        cols = 2 * self.spec.length - ANCHOR
        cols += -cols % 8
        padded = np.frombuffer(bytes(width) + self.data + bytes(cols), np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(padded, cols)[self.seg.anchor[at]]  # starts `width` before the anchor
        where = np.arange(cols)
        lo = width - left
        rows = np.where((where >= lo[:, None]) & (where < (lo + count + self.spec.length - 1)[:, None]), rows, 0).astype(np.uint8)
        order, new = _same_rows(rows, (left << 16) + count)
        item = np.empty(len(at), dtype=np.int64)
        item[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        doc = self.doc[at]
        least = np.minimum.reduceat(doc[order], first) if len(first) else doc
        pick = order[first]
        return rows[pick], left[pick], count[pick], least, at, item


def _same_rows(rows: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where in it a row differs from the one before."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = more.astype(np.uint64)
    for digit in rows.view("<u8").T:
        h = _mix(h ^ digit)
    order = np.argsort(h, kind="stable")
    r, m = rows[order], more[order]
    same = (h[order][1:] == h[order][:-1]) & (m[1:] == m[:-1])
    same &= (r[1:] == r[:-1]).all(axis=1)
    return order, np.concatenate([[True], ~same])


def _by_bucket(batches: Iterator[pa.RecordBatch], work: Callable[[int, list[dict]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Calls work for each run of rows with one bucket; batches are sorted by it."""
    held: list[dict] = []
    for row in _each(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            if (out := work(held[0]["bucket"], held)) is not None:
                yield out
            held = []
        held.append(row)
    if held and (out := work(held[0]["bucket"], held)) is not None:
        yield out


def _send_keys(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            d, bucket, several, _ = Blob(r["ids"], r["sizes"], r["data"], spec).keys()
            if not len(d):
                continue
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.concatenate([cut[1:], [len(d)]])
            out = []
            for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
                steps = np.diff(d[a:b], prepend=d[a : a + 1])
                wide = int(steps.max()) >= 1 << 32
                body = _squeeze(d[a : a + 1], steps.astype("<u8" if wide else "<u4"), np.packbits(several[a:b]))
                out.append((int(bucket[a]), r["blob"], b - a, wide, body))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "blob", "n", "wide", "body"])

    return run


def _answer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        keys, several = [], []
        for r in rows:
            body, n, size = _expand(r["body"]), r["n"], 8 if r["wide"] else 4
            first = np.frombuffer(body, "<u8", 1)
            steps = np.frombuffer(body, "<u8" if r["wide"] else "<u4", n, 8).astype(np.uint64)
            keys.append(first + np.cumsum(steps, dtype=np.uint64))
            several.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=8 + size * n), count=n).astype(bool))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        k = every[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        dup = np.diff(np.concatenate([first, [len(k)]])) > 1
        dup |= np.logical_or.reduceat(np.concatenate(several)[order], first)
        bits = np.empty(len(k), dtype=bool)
        bits[order] = dup[group]
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        masks = [np.packbits(bits[e - r["n"] : e]).tobytes() for e, r in zip(ends, rows, strict=True)]
        return pa.record_batch([pa.array([bucket] * len(rows), pa.int64()), pa.array([r["blob"] for r in rows], pa.int64()), pa.array(masks, pa.binary())], ["bucket", "blob", "mask"])

    return _by_bucket(batches, work)


def _answers(row: dict) -> list[tuple[int, bytes]]:
    return [(x["bucket"], x["mask"]) for x in row["masks"] or ()]


def _send_items(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            blob = Blob(r["ids"], r["sizes"], r["data"], spec)
            rows, left, count, least, at, item = blob.items(blob.shared(_answers(r)))
            if not len(rows):
                continue
            key = np.empty(len(rows), dtype=np.uint64)
            key[item] = blob.seg.key[at]
            bucket = spec.bucket(key)
            order = np.argsort(bucket, kind="stable")
            where = np.arange(rows.shape[1])
            lo = spec.length - ANCHOR - left
            inside = (where >= lo[:, None]) & (where < (lo + count + spec.length - 1)[:, None])
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            out = []
            for i in np.split(order, cut):
                body = _squeeze(i.astype("<u4"), left[i].astype("<u2"), count[i].astype("<u2"), least[i].astype("<i8"), rows[i][inside[i]])
                out.append((int(bucket[i[0]]), r["blob"], len(i), body))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "blob", "n", "body"])

    return run


def least_documents(rows: np.ndarray, left: np.ndarray, count: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """rows: contents with the anchor's column fixed. Returns for every window of every row (rows in order) the smallest doc_id of an equal window, and the row."""
    order, new = _same_rows(rows, (left << 16) + count)
    first = np.flatnonzero(new)
    kind = np.empty(len(rows), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    pick = order[first]
    best = np.minimum.reduceat(least[order], first)
    x, a, c = np.ascontiguousarray(rows[pick]), left[pick], count[pick]
    n = len(x)
    begin = np.cumsum(c) - c
    which = np.repeat(np.arange(n), c)
    start = np.repeat(length - ANCHOR - a, c) + np.arange(len(which)) - np.repeat(begin, c)
    found = np.repeat(best, c)
    x = np.concatenate([x, np.zeros((n, 8), np.uint8)], axis=1)
    word = _words(x, (n, x.shape[1] - 7), (x.shape[1], 1))
    # Most significant digit first: the anchor with the window's place, then eight bytes at a time; what is alone goes.
    live = np.arange(len(which))
    group = _mix(_mix(word[which, length - ANCHOR]) ^ word[which, length - ANCHOR + 8]) + start.astype(np.uint64) * C3
    digit = np.zeros(len(which), dtype=np.uint64)
    for at in (None, *range(0, length - 8, 8), length - 8):
        if at is not None:
            digit = word[which[live], start[live] + at]
            group = _mix(group * C3 ^ digit)
        o = np.argsort(group, kind="stable")
        g = group[o]
        same = g[1:] == g[:-1]
        if at is not None:
            same &= (digit[o][1:] == digit[o][:-1]) & (was[o][1:] == was[o][:-1])
        edge = np.concatenate([[True], ~same])
        alone = edge & np.concatenate([edge[1:], [True]])
        number = np.cumsum(edge)
        keep = o[~alone]
        live, group, was = live[keep], group[keep], number[~alone]
        if not len(live):
            break
    if len(live):
        edges = np.flatnonzero(np.concatenate([[True], was[1:] != was[:-1]]))
        low = np.minimum.reduceat(found[live], edges)
        found[live] = np.repeat(low, np.diff(np.concatenate([edges, [len(live)]])))
    row = np.repeat(np.arange(len(rows)), count)
    return found[np.repeat(begin[kind], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)], row


def _answer_items(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = spec.length - ANCHOR
        cols = 2 * spec.length - ANCHOR
        cols += -cols % 8

        def work(bucket: int, messages: list[dict]) -> pa.RecordBatch | None:
            got = []
            for m in messages:
                body, n = _expand(m["body"]), m["n"]
                item, left, count, least = (np.frombuffer(body, t, n, o * n) for t, o in (("<u4", 0), ("<u2", 4), ("<u2", 6), ("<i8", 8)))
                got.append((item.astype(np.int64), left.astype(np.int64), count.astype(np.int64), least, np.frombuffer(body, np.uint8, offset=16 * n)))
            item, left, count, least, flat = (np.concatenate(x) for x in zip(*got, strict=True))
            rows = np.zeros((len(item), cols), dtype=np.uint8)
            where, lo = np.arange(cols), width - left
            rows[(where >= lo[:, None]) & (where < (lo + count + spec.length - 1)[:, None])] = flat
            low, row = least_documents(rows, left, count, least, spec.length)
            smaller = low < least[row]
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            edge = smaller.copy()
            edge[1:] &= ~(smaller[:-1] & (row[1:] == row[:-1]) & (low[1:] == low[:-1]))
            first = np.flatnonzero(edge)
            run_of = np.cumsum(edge) - 1
            size = np.bincount(run_of[smaller], minlength=len(first))
            ends = np.cumsum([m["n"] for m in messages])
            blob = np.searchsorted(ends, row[first], "right")
            out = []
            for i, m in enumerate(messages):
                a, b = np.searchsorted(blob, i), np.searchsorted(blob, i, "right")
                if a < b:
                    f = first[a:b]
                    out.append((m["blob"], int(b - a), _squeeze(item[row[f]].astype("<u4"), place[f].astype("<u2"), size[a:b].astype("<u2"), low[f].astype("<i8"))))
            if not out:
                return None
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["blob", "n", "body"])

        yield from _by_bucket(batches, work)

    return run


def covered(blob: Blob, shared: np.ndarray, runs: list[dict]) -> np.ndarray:
    """A boolean for each byte of the blob: it lies in a window that starts in a smaller doc_id too."""
    _, _, count, least, at, item = blob.items(shared)
    begin = np.cumsum(count) - count
    low = np.repeat(least, count)
    for r in runs:
        body, n = _expand(r["body"]), r["n"]
        i, place, size, doc = (np.frombuffer(body, t, n, o * n) for t, o in (("<u4", 0), ("<u2", 4), ("<u2", 6), ("<i8", 8)))
        s = size.astype(np.int64)
        low[np.repeat(begin[i] + place, s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)] = np.repeat(doc, s)
    change = np.zeros(len(blob.data) + 1, dtype=np.int64)
    c = count[item]
    k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    gone = low[np.repeat(begin[item], c) + k] < np.repeat(blob.doc[at], c)
    starts = (np.repeat(blob.seg.first[at], c) + k)[gone]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + blob.spec.length, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_bytes(docs: DataFrame, finish: Callable[[Blob, np.ndarray, bytes | None], pa.RecordBatch], schema, length: int = LENGTH, carry: bool = False) -> DataFrame:
    """Applies finish to each blob, its covered bytes and what it carries. docs: doc_id, text; all columns are carried if carry is set."""
    if length < ANCHOR + 1 or length > 1 << 15:
        raise ValueError(f"length {length} is not within {ANCHOR + 1} and {1 << 15}")
    blobs = make_blobs(docs, carry)
    total = blobs.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).head()[0]
    expected = 2.2 * total / (length - ANCHOR + 2)
    spec = Spec(length, max(16, math.ceil(total / WINDOWS_A_BUCKET)), min(64, max(40, math.ceil(math.log2(expected + 2)) + 14)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(spec.buckets, "bucket").sortWithinPartitions("bucket", "blob")

    texts = blobs.drop("rest")
    keys = dealt(texts.mapInArrow(_send_keys(spec), "bucket bigint, blob bigint, n bigint, wide boolean, body binary"))
    masks = keys.mapInArrow(_answer_keys, "bucket bigint, blob bigint, mask binary").groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias("masks"))
    masks = materialise(masks, "masks")
    items = dealt(texts.join(masks, "blob").mapInArrow(_send_items(spec), "bucket bigint, blob bigint, n bigint, body binary"))
    runs = items.mapInArrow(_answer_items(spec), "blob bigint, n bigint, body binary").groupBy("blob").agg(F.collect_list(F.struct("n", "body")).alias("runs"))
    runs = materialise(runs, "runs")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            blob = Blob(r["ids"], r["sizes"], r["data"], spec)
            yield finish(blob, covered(blob, blob.shared(_answers(r)), r["runs"] or []), r["rest"])

    return blobs.join(masks.join(runs, "blob", "left"), "blob", "left").mapInArrow(last, schema)


def _digest(blob: Blob, gone: np.ndarray, _: bytes | None) -> pa.RecordBatch:
    ends = np.cumsum(blob.sizes).tolist()
    out = []
    data = np.frombuffer(blob.data, np.uint8)
    for doc, n, e in zip(blob.ids, blob.sizes.tolist(), ends, strict=True):
        g = gone[e - n : e]
        spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
        out.append((doc, n, int(g.sum()), spans, hashlib.sha256(data[e - n : e][~g].tobytes()).hexdigest()))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes if a window of `length` bytes over it starts in a row with a strictly smaller doc_id too. Rows with
    equal doc_id do not affect each other; rows with a null doc_id neither lose bytes nor make others lose any. A null
    text is empty; texts shorter than `length` keep all. Other columns are not read. An empty table gives no rows.
    """
    return repeated_bytes(docs, _digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", length)


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of `text`; all rows and columns stay, and `n_chars`, if there, counts anew.

    A character goes if all its bytes do. A text that loses all is empty; a null text becomes empty. Otherwise as
    `removal_digests`.
    """
    schema = docs.schema
    names = schema.fieldNames()

    def finish(blob: Blob, gone: np.ndarray, rest: bytes | None) -> pa.RecordBatch:
        table = pa.ipc.open_stream(_expand(rest)).read_all().combine_chunks()
        data = np.frombuffer(blob.data, np.uint8)
        head = (data & 0xC0) != 0x80  # first bytes of characters
        if len(data):
            first = np.flatnonzero(head)
            whole = np.logical_and.reduceat(gone, first)
            gone = np.repeat(whole, np.diff(np.concatenate([first, [len(data)]])))
        ends = np.cumsum(blob.sizes).tolist()
        texts = [data[e - n : e][~gone[e - n : e]].tobytes().decode("utf-8", "replace") for e, n in zip(ends, blob.sizes.tolist(), strict=True)]
        cols = []
        for c in names:
            if c == "text":
                cols.append(pa.array(texts, pa.string()))
            elif c == "n_chars":
                cols.append(pa.array([len(t) for t in texts], pa.int64()).cast(table.schema.field(c).type))
            else:
                cols.append(table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type))
        return pa.record_batch(cols, names)

    return repeated_bytes(docs, finish, schema, length, carry=True)

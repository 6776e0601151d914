"""GIF media columns: LZW code streams, palettes, disposal and transparency; timed frames with colour histograms.

Samples are stored as palette indices, so any bytes survive. Frames are bounded in size and coded on their own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.tokens import slices

WIDTH, ROWS_A_FRAME, DELAY = 64, 1024, 10
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
LAST = 4096


def _widths(root: int, n: int) -> np.ndarray:
    """Bits of the i-th code after a clear code: the table has grown by one entry with each code but the first."""
    size = np.maximum((1 << root) + 1 + np.arange(n), 1 << root)
    return np.minimum(np.frexp(size.astype(np.float64))[1], 12).astype(np.int64)


def lzw_encode(samples: bytes, root: int = 8) -> bytes:
    """The code stream of samples below 2^root; the table is cleared when it is full."""
    clear, first = 1 << root, (1 << root) + 2
    codes, table, size = [clear], {}, first
    put, get = codes.append, table.get
    widths = [_widths(root, 1)]
    of, start = _widths(root, LAST), 1
    it = iter(samples)
    w = next(it, None)
    if w is not None:
        for c in it:
            k = w << 8 | c
            v = get(k)
            if v is not None:
                w = v
                continue
            put(w)
            table[k] = size
            size += 1
            w = c
            if size == LAST:
                put(clear)
                widths.append(of[: len(codes) - start])
                start = len(codes)
                table.clear()
                size = first
        put(w)
    put(clear + 1)
    widths.append(of[: len(codes) - start])
    return _pack(np.array(codes, dtype=np.int64), np.concatenate(widths))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    shifted, byte = codes << (at & 7), at >> 3
    n = int(ends[-1] + 7) // 8
    out = np.zeros(n + 3, dtype=np.float64)
    for k in range(3):  # bits of different codes never meet, so their sum is their union
        out += np.bincount(byte + k, (shifted >> (8 * k) & 255).astype(np.float64), n + 3)
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, root: int, most: int) -> bytes:
    """Up to `most` samples of a code stream; a table that is full stays as it is until it is cleared.

    Raises ValueError for a code that the table can't hold yet.
    """
    clear, first = 1 << root, (1 << root) + 2
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, total, have = 0, 8 * len(stream), 0
    ends = np.cumsum(_widths(root, 2 * LAST))
    offsets = np.concatenate([[0], ends[:-1]])
    table: list[bytes] = []
    prev, seen = b"", 0  # codes since the last clear
    while at < total and have < most:
        n = len(ends) if seen < LAST else 0
        if n:
            lo = offsets + at - (offsets[seen] if seen else 0)
            lo, w = lo[seen:], np.diff(np.concatenate([offsets, ends[-1:]]))[seen:]
        else:
            w = np.full(LAST, 12)
            lo = at + 12 * np.arange(LAST)
        fits = lo + w <= total
        lo, w = lo[fits], w[fits]
        if not len(lo):
            break
        b = lo >> 3
        codes = (data[b] | data[b + 1] << 8 | data[b + 2] << 16) >> (lo & 7) & (1 << w) - 1
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        end = int(stop[0]) if len(stop) else len(codes)
        run = codes[:end].tolist()
        if run and not prev:
            table = literals.copy()
            if run[0] >= clear:
                raise ValueError(f"code {run[0]} after a clear code")
            prev = table[run[0]]
            out.append(prev)
            rest = run[1:]
        else:
            rest = run
        put, size = out.append, len(table)
        for c in rest:
            if c > size:
                raise ValueError(f"code {c} in a table of {size}")
            entry = table[c] if c < size else prev + prev[:1]
            if size < LAST:
                table.append(prev + entry[:1])
                size += 1
            put(entry)
            prev = entry
        have += sum(map(len, out[-len(run) :])) if run else 0
        if len(stop):
            if codes[end] == clear + 1:
                break
            at = int(lo[end] + w[end])
            prev, seen = b"", 0
        else:
            at = int(lo[-1] + w[-1])
            seen += len(run)
    return b"".join(out)[:most]


def encode(frames: list[np.ndarray], palette: np.ndarray = GREY, delay: int = DELAY, disposal: int = 1, transparent: int | None = None) -> bytes:
    """frames: index arrays, rows x columns, placed at the upper left; delay in hundredths of a second."""
    width, height = max(f.shape[1] for f in frames), max(f.shape[0] for f in frames)
    bits = max(2, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), dtype=np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | bits - 1, 0, 0), table.tobytes()]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0))
        code = lzw_encode(f.tobytes(), bits)
        out.append(bytes([bits]))
        out += [bytes([len(c)]) + c for c in (code[i : i + 255] for i in range(0, len(code), 255))]
        out.append(b"\0")
    return b"".join([*out, b";"])


@dataclass
class Frame:
    delay: int  # hundredths of a second
    canvas: np.ndarray  # rows x columns x 3, after composition
    samples: np.ndarray  # the frame's own indices


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """Frames in order, composed by disposal and transparency, interlace undone. Raises ValueError where the stream is damaged."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the stream ends early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, GREY
    if flags & 0x80:
        n = 2 << (flags & 7)
        common, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    blank = common[background] if flags & 0x80 and background < len(common) else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(blank, (height, width, 3)).copy()
    delay, disposal, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, end = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal, clear = body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]:#x}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, common
        if local & 0x80:
            n = 2 << (local & 7)
            palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        root = data[at]
        code, at = _blocks(data, at + 1)
        if not 2 <= root <= 8:
            raise ValueError(f"code size {root}")
        got = lzw_decode(code, root, w * h)
        if len(got) < w * h:
            raise ValueError(f"{len(got)} of {w * h} samples")
        image = np.frombuffer(got, np.uint8).reshape(h, w)
        if local & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(image)
            straight[order] = image
            image = straight
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        seen = image[: part.shape[0], : part.shape[1]]
        colours = palette[np.minimum(seen, len(palette) - 1)]
        if clear is None:
            part[:] = colours
        else:
            part[seen != clear] = colours[seen != clear]
        yield Frame(delay, canvas.copy(), image)
        if disposal == 2:
            part[:] = blank
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None
    if at >= len(data):
        raise ValueError("no trailer")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """64 colour bins: two leading bits of red, green and blue."""
    q = canvas >> 6
    return np.bincount((q[..., 0] << 4 | q[..., 1] << 2 | q[..., 2]).ravel(), minlength=64)


def payload(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def store(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Writes a table doc_id, n_bytes, media (GIF of the padded UTF-8 bytes) in the shared folder.

    A null text is empty and has one row of zero samples. Rows that repeat stay. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                media = []
                for t in texts:
                    rows = np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)
                    media.append(encode([rows[i : i + ROWS_A_FRAME] for i in range(0, len(rows), ROWS_A_FRAME)]))
                yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "gif")


FRAME_SCHEMA = "doc_id bigint, frame int, at_ms bigint, delay_ms int, width int, height int, samples binary, histogram array<int>, error string"


def frames(media: DataFrame) -> DataFrame:
    """media: doc_id, media. One row for each frame with its time and the colour histogram of the composed canvas.

    Null media give none. A damaged stream gives the frames before the damage and then a row with nothing but doc_id
    and `error`.
    """
    names = [c.split()[0] for c in FRAME_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.string()]

    def rows(doc: int | None, data: bytes) -> Iterator[list]:
        at = 0
        try:
            for i, f in enumerate(decode(data)):
                yield [doc, i, at, 10 * f.delay, f.canvas.shape[1], f.canvas.shape[0], f.samples.tobytes(), histogram(f.canvas).tolist(), None]
                at += 10 * f.delay
        except ValueError as e:
            yield [doc, *[None] * 7, str(e)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                for row in rows(doc, data) if data is not None else ():
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, FRAME_SCHEMA)


DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"


def digests(media: DataFrame) -> DataFrame:
    """What op5 returns, from the stored media alone; `feature` holds frames, milliseconds and the summed histogram.

    A damaged stream has its reason in `error` and nothing about payload and feature; null media have nulls alone.
    """

    def described(data: bytes) -> tuple:
        sha, size, tail, n, ms, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, dtype=np.int64)
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            for f in decode(data):
                raw = f.samples.tobytes()
                sha.update(raw)
                size, tail, n, ms = size + len(raw), raw[-64:], n + 1, ms + 10 * f.delay
                bins += histogram(f.canvas)
        except ValueError as e:
            return None, None, None, *stored, None, str(e)
        feature = f"frames={n};ms={ms};histogram=" + ",".join(f"{i}:{c}" for i, c in enumerate(bins.tolist()) if c)
        return size, sha.hexdigest(), zlib.crc32(tail), *stored, feature, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
        for batch in batches:
            for part in slices(batch, "media"):
                cols = list(zip(*[described(x) if x is not None else (None,) * 7 for x in part.column("media").to_pylist()], strict=True))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return media.mapInArrow(run, DIGEST_SCHEMA)


def document_media(docs: DataFrame) -> DataFrame:
    """Stores each whole text as a GIF, reads the stored bytes back and describes them; an empty table gives no rows."""
    return digests(store(docs))

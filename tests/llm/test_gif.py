import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_tables_that_fill_and_clear():
    data = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"\0" * 40_000 + b"ab" * 20_000
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_a_table_that_stays_full():
    """A stream without clear codes after the table is full: codes stay at twelve bits."""
    data = bytes(range(256)) * 60
    codes, table, size, w = [256], {bytes([i]): i for i in range(256)}, 258, b""
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append(table[w])
        if size < 4096:
            table[w + bytes([b])] = size
            size += 1
        w = bytes([b])
    codes += [table[w], 257]
    widths = np.concatenate([[9], gif._widths(8, len(codes) - 1)])
    assert gif.lzw_decode(gif._pack(np.array(codes), widths), 8, len(data)) == data


def test_palette_transparency_and_disposal():
    palette = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    a, b = np.zeros((2, 2), np.uint8), np.array([[1, 3], [3, 2]], np.uint8)
    first, second = gif.decode(gif.encode([a, b], palette, delay=7, disposal=1, transparent=3))
    assert first.delay == 7 and (first.canvas == palette[0]).all()
    assert second.canvas.tolist() == [[[0, 255, 0], [255, 0, 0]], [[255, 0, 0], [0, 0, 255]]]
    _, back = gif.decode(gif.encode([a, b], palette, disposal=2, transparent=3))  # the first frame's area is cleared
    assert back.canvas[0, 1].tolist() == palette[0].tolist() and back.canvas[0, 0].tolist() == [0, 255, 0]
    _, kept = gif.decode(gif.encode([a, b], palette, disposal=3, transparent=3))
    assert kept.canvas.shape == (2, 2, 3)
    with pytest.raises(ValueError):
        list(gif.decode(b"no picture"))


ROWS = [(1, "text", b"x"), (2, None, b"x"), (3, "", b"x"), (4, "ü" * 40_000, b"x"), (1, "text", b"x"), (None, "z" * 64, b"x")]


def test_documents_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, media binary")
    got = gif.document_media(docs).collect()
    want = []
    for doc, text, _ in ROWS:
        raw = (text or "").encode()
        p = gif.payload(raw)
        assert len(p) % 64 == 0 and p.rstrip(b"\0") == raw
        want.append((doc, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    same = [tuple(r)[1:] for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]
    frames = gif.frames(gif.store(docs.where("doc_id = 4"))).orderBy("frame").collect()
    assert [f["at_ms"] for f in frames] == [100 * i for i in range(len(frames))] and len(frames) == 2
    assert b"".join(bytes(f["samples"]) for f in frames) == gif.payload(("ü" * 40_000).encode())
    assert all(sum(f["histogram"]) == f["width"] * f["height"] for f in frames)


def test_empty_table(spark):
    assert gif.document_media(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


#: Ten by ten samples of four colours, written by hand from the format's description, not by this library.
BY_HAND = bytes.fromhex("474946383961 0A000A00910000 FFFFFFFF00000000FF000000 21F9040000000000 2C000000000A000A0000 02168C2D99872A1CDC33A00275EC95FAA8DE608C04914C0100 3B".replace(" ", ""))
PICTURE = [[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2 + [[2] * 3 + [0] * 4 + [1] * 3] * 2 + [[2] * 5 + [1] * 5] * 3


def test_a_stream_made_elsewhere():
    (f,) = gif.decode(BY_HAND)
    assert f.samples.tolist() == PICTURE
    assert f.canvas[0, 0].tolist() == [255, 0, 0] and f.canvas[9, 0].tolist() == [0, 0, 255] and f.canvas[4, 4].tolist() == [255, 255, 255]


def test_interlace_and_a_local_palette():
    at = BY_HAND.index(b"\x2c") + 9
    local = bytes([7, 7, 7, 1, 2, 3, 4, 5, 6, 9, 9, 9])
    (f,) = gif.decode(BY_HAND[:at] + b"\xc1" + local + BY_HAND[at + 1 :])
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]  # the passes: every eighth from 0, from 4, every fourth from 2, every second from 1
    assert [f.samples.tolist()[r] for r in rows] == PICTURE
    assert f.canvas[0, 0].tolist() == [1, 2, 3] and f.canvas[0, 9].tolist() == [4, 5, 6]


def test_damaged_streams_are_rows_with_an_error(spark):
    good = gif.encode([np.zeros((4, 4), np.uint8), np.ones((4, 4), np.uint8)])
    cut = BY_HAND[:-8]
    wild = BY_HAND.replace(bytes.fromhex("168C2D"), bytes.fromhex("16FCFF"))
    media = [(1, 5, good), (2, 5, cut), (3, 5, wild), (4, 5, b"no picture"), (5, 5, None), (6, 5, good[:-20]), (7, 5, b"")]
    df = spark.createDataFrame(media, "doc_id bigint, n_bytes bigint, media binary")
    got = {r["doc_id"]: r for r in gif.digests(df).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 32
    for k in (2, 3, 4, 6, 7):
        assert got[k]["error"] and got[k]["payload_sha256"] is None and got[k]["feature"] is None and got[k]["media_bytes"] == len(media[k - 1][2])
    assert got[5]["media_bytes"] is None and got[5]["error"] is None
    rows = gif.frames(df).collect()
    assert sorted((r["doc_id"], r["frame"]) for r in rows if r["error"] is None) == [(1, 0), (1, 1), (6, 0)]
    assert sorted(r["doc_id"] for r in rows if r["error"]) == [2, 3, 4, 6, 7]

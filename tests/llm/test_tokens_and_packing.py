import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heddle.llm import packing, tokenfile
from heddle.llm.tokens import Encoder

ODD = [
    "", " ", "a\x1cb c", "it's  they'll\n\nx²y 12", "</s><|endoftext|> é éx Ünï", "日本語 text テスト", "  lead and trail  ", "İstanbul ΣΑΣ", "a" * 200 + " b", " x  y", "ﬁ Å ½", "word, word. word!",
    "tab\tnew\nline\r\n", "The%%% THE the", "don't DON'T", "\u200bzero\u200bwidth", "e\u0301 o\u0308",
]
DOCS = [(3, "one two three", 1), (1, None, 2), (2, "", 3), (None, "no id", 4), (5, "word " * 3000, 5), (5, "same id", 6), (3, "one two three", 7), (9, "ünï çode. x", 8)]


ODD += ["<|endoftext|> hi", "a <|startoftext|>b <|ENDOFTEXT|>", "x<|endoftext|>", "a  b", "a   b", "end ", "end  ", " \n b", "a \n\n b\t c", "a\u00a0 b \u00a0c", "Und.\nIe keit.\n\nX", " \u0301mark", "one.\nTwo, three!\nFour"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    e, whole = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = pa.array([*ODD, None, *ODD, "word " * 300])
    want = [whole.encode(t or "", add_special_tokens=False).ids + [7] for t in texts.to_pylist()]
    for _ in range(2):  # the second time from memory
        ids, ends = e.encode(texts, 7)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    ids, ends = e.encode(pa.array([], pa.string()), 7)
    assert len(ids) == 0 and ends.tolist() == [0]


@given(st.lists(st.text(alphabet=" \n\t\u00a0\x1caZé'.,-1<|\u0301ﬁ", max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
@pytest.mark.parametrize("e", [Encoder(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")], ids=["word", "byte"])
def test_any_white_space_and_marks(e, texts):
    ids, ends = e.encode(pa.array(texts, pa.string()), 0)
    assert [ids[a : b - 1].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def frame(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id bigint, text string, start int")


def test_token_file_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokenfile.token_digests(frame(spark), path).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 5, 5, 9]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    by = {(r["doc_id"], r["n_tokens"]): r["ids_crc32"] for r in got}
    for doc, text, _ in DOCS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert by[doc, len(ids)] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file_in_many_ranges_and_lookup(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(97)], "doc_id bigint, text string").repartition(5)
    from heddle.llm.common import new_path

    path = new_path(spark, "t")
    tokenfile.write_token_file(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1, docs_a_file=10)
    rows = tokenfile.read_token_file(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(97))
    assert rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:-1])
    assert [r["ids"] for r in tokenfile.lookup(spark, path, [42]).collect()] == [rows[42]["ids"]]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert tokenfile.token_digests(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_fill_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, 5)}
        room = int(rng.integers(1, 60))
        best = {0}
        for n, c in counts.items():
            best = {s + n * k for s in best for k in range(c + 1) if s + n * k <= room}
        uses = packing.fill(counts, room)
        assert all(0 < u <= counts[n] for n, u in uses.items())
        assert sum(n * u for n, u in uses.items()) == max(best)


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(2)
    counts = {int(n): int(rng.integers(1, 1000)) for n in rng.integers(1, 1024, 300)}
    seen = dict.fromkeys(counts, 0)
    for uses, repeats in packing.plan(counts):
        assert repeats > 0 and sum(n * u for n, u in uses.items()) <= 1024
        for n, u in uses.items():
            seen[n] += u * repeats
    assert seen == counts


def test_packing_places_every_token_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = DOCS + [(100 + i, "some words here " * (i % 90), 0) for i in range(300)]
    got = packing.pack_documents(frame(spark, docs), path).collect()
    t = Tokenizer.from_file(path)
    want = sorted((d or -1, len(x), zlib.crc32(np.array(x[i : i + 1024], "<u4").tobytes()), i) for d, s, _ in docs for x in [t.encode(s or "", add_special_tokens=False).ids + [0]] for i in range(0, len(x), 1024))
    assert sorted((r["doc_id"] or -1, r["doc_tokens"], r["ids_crc32"], r["start"]) for r in got) == want
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024 and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) > 0.97 * 1024 * len(fill)


def test_ties_and_empty_counts():
    assert packing.plan({}) == [] and packing.plan({5: 0}) == [] and packing.fill({}, 9) == {}
    windows = packing.plan({512: 3, 1: 1, 1023: 1}, 1024)
    assert sorted((n, u * k) for uses, k in windows for n, u in uses.items()) == [(1, 1), (512, 1), (512, 2), (1023, 1)]


def test_lookup_skips_stripes(spark):
    """A filter on doc_id is handed to the ORC reader, and most files hold a Bloom filter that rules it out."""
    from heddle.llm.common import new_path

    docs = spark.createDataFrame([(3 * i, "words " * 50) for i in range(4000)], "doc_id bigint, text string")
    path = new_path(spark, "t")
    tokenfile.write_token_file(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1, docs_a_file=1000)
    found = spark.read.schema(tokenfile.SCHEMA).orc(path).where("doc_id = 3000")
    plan = found._jdf.queryExecution().executedPlan()
    assert "EqualTo(doc_id,3000)" in plan.toString() and found.count() == 1
    read = tokenfile.lookup(spark, path, [3000, 3001])
    assert [r["doc_id"] for r in read.collect()] == [3000]
    scanned = found.select("doc_id", "ids")
    rows = scanned._jdf.queryExecution().executedPlan()
    scanned._jdf.queryExecution().toRdd().count()
    scan = rows.collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 1000  # one row group of the 4000 rows

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import chat, sharding


def test_matrix_has_exact_margins_and_the_right_mean():
    counts = np.array([100, 0, 37, 263, 1])
    total = np.zeros((5, 16))
    for seed in range(200):
        m = sharding.communication_matrix(counts, 16, seed)
        assert (m >= 0).all() and (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
        total += m
    assert np.abs(total / 200 - counts[:, None] / 16).max() < 1.5


def test_matrix_follows_the_law():
    counts = np.array([3, 2, 4])  # 9 rows to 2 shards of 5 and 4; every cell by its exact chance
    seen = {}
    n = 4000
    for seed in range(n):
        m = sharding.communication_matrix(counts, 2, seed)
        big = int(m.sum(axis=0).argmax())
        seen[tuple(m[:, big])] = seen.get(tuple(m[:, big]), 0) + 1
    chi = cells = 0
    for a in range(4):
        for b in range(3):
            c = 5 - a - b
            if 0 <= c <= 4:
                p = math.comb(3, a) * math.comb(2, b) * math.comb(4, c) / math.comb(9, 5)
                chi, cells = chi + (seen.get((a, b, c), 0) - n * p) ** 2 / (n * p), cells + 1
    assert sum(seen.values()) == n and chi < cells - 1 + 4 * math.sqrt(2 * (cells - 1))


@pytest.mark.parametrize("good,bad,n", [(7, 9, 5), (30, 4, 20), (1, 50, 10), (40, 60, 50), (5, 5, 10), (6, 2, 0)])
def test_large_sampler_follows_the_law(good, bad, n):
    exact = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if k <= good and 0 <= n - k <= bad else 0 for k in range(n + 1)]
    assert all(abs(math.exp(sharding.log_hypergeometric(k, good, bad, n)) - p) < 1e-12 for k, p in enumerate(exact))
    rng, draws = np.random.Generator(np.random.PCG64(5)), 20_000
    seen = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(draws)], minlength=n + 1)
    use = [k for k, p in enumerate(exact) if p * draws >= 5]
    chi = sum((seen[k] - draws * exact[k]) ** 2 / (draws * exact[k]) for k in use)
    assert chi < len(use) - 1 + 4 * math.sqrt(2 * max(len(use) - 1, 1))


def test_large_populations_have_exact_margins_mean_and_variance():
    counts = np.full(40, 10**11)
    m = sharding.communication_matrix(counts, 16, 3)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    rng = np.random.Generator(np.random.PCG64(6))
    good, bad, n = 3 * 10**12, 10**12, 10**9
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)], dtype=float)
    mean, var = n * 0.75, n * 0.75 * 0.25 * (good + bad - n) / (good + bad - 1)
    assert abs(x.mean() - mean) < 4 * math.sqrt(var / 4000) and abs(x.var() / var - 1) < 0.1


def test_shards(spark):
    rows = [(i, f"text {i % 7}" * (i % 5), 1, 2) for i in range(1003)] + [(5, None, 1, 2), (5, "", 1, 2), (None, "é", 1, 2), (5, "", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, slot int")
    got = sharding.document_shards(df).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.document_shards(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    order = [r["doc_id"] or 0 for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15
    assert sharding.document_shards(df.limit(0)).collect() == []
    assert len(sharding.document_shards(df.limit(3)).collect()) == 3


PROBE = "</s>[INST] ok [/INST]"


def test_digests_against_plain(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", PROBE), (1, 2, "assistant", PROBE), (2, 0, "assistant", "first"), (3, 1, "assistant", "b"), (3, 0, "user", None), (3, 0, "user", None),
        (4, None, None, "\\<s> <\\s> \\\\"), (None, 0, "user", "null id"), (5, 0, "user", "x\n</s>\n<s>assistant\ny"), (5, 1, "assistant", "é𝄞" * 30_000), (6, 0, "tool\nx\\n", ""),
    ]
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id bigint, turn bigint, role string, text string, valid boolean")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c: got[c]["valid"] for c in got} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True, 6: False}
    assert chat.conversation_digests(df.limit(0)).collect() == []


TEMPLATES = [chat.DEFAULT, chat.Template(open="<|im_start|>", close="<|im_end|>\n"), chat.Template(open="abab", close="im;", controls=("aab", "bb"))]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="<>s/[]INST\\ a\n|im_endb;", max_size=30) | st.sampled_from(["<|im_end|>", "<|im_end|>\n<|im_start|>assistant\n", "ababab;ba", "</s>\n", "aabb"]), min_size=1, max_size=60))
@pytest.mark.parametrize("template", TEMPLATES, ids=["default", "im", "overlapping"])
def test_texts_are_read_back_whatever_the_template(spark, template, texts):
    df = spark.createDataFrame([(i // 3, i % 3, texts[-i] if i % 3 == 2 else "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_conversations(df, template), template).select("conv_id", "turns").collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(i // 3, []).append((texts[-i] if i % 3 == 2 else "user", t))
    assert got == want
    for e, u, t in df.select(chat.escape(df["text"], template), chat.unescape(chat.escape(df["text"], template)), "text").collect():
        assert u == t and not any(c in e for c in template.guarded())


def test_templates_that_cannot_be_read_back_are_refused():
    for bad in ({"close": "|"}, {"close": "aba"}, {"open": "<s\\>"}, {"open": "x<", "close": "</s>"}, {"controls": ("",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)

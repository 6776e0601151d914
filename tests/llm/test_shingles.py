import random
import re

import public_tokenizers
import pyarrow as pa

from heddle.llm import shingles, simhash


def plain_kept(rows):
    """Documents that no smaller doc_id is connected with, by every pair's similarity."""

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {d for i, (d, _) in enumerate(rows) if d is not None and least[find(i)] == d}


def test_keep_one_is_exact_at_every_length(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    rows = []
    for length in (3, 6, 9, 10, 12, 20, 30, 50, 120, 300):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(length)]
            rows.append(" ".join(base))
            rows.append(" ".join([*base, rng.choice(words)]))
            last = [*base[:-1], rng.choice(words)]
            rows.append(" ".join(last))
            some = list(base)
            for _ in range(max(1, length // 45)):
                some[rng.randrange(length)] = rng.choice(words)
            rows.append(" ".join(some))
            rng.shuffle(base)
            rows.append(" ".join(base))  # the same vocabulary, no shingle in common
    line = " ".join(rng.choice(words) for _ in range(15))
    rows += [line + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows += [None, "", " \n"]
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(None, rows[3]), (5000, rows[7].upper())]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got - {None} == plain_kept(rows)


def test_sketches_tell_long_texts_apart_and_lose_no_alike_pair(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(6)) for _ in range(5000)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (500, 520, 1000, 1200, 3000, 3300, 4200, 9000)]
    texts = [b for b in bases] + [[rng.choice(words), *b[1:-20], "end"] for b in bases]
    rows = shingles._described(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string"), 0)
    told = rows.orderBy("doc_id").collect()
    node = [r["node"] for r in told]
    want = {tuple(sorted((node[i], node[i + 8]))) for i in range(8)}
    every = spark.createDataFrame([(a, b) for a in node for b in node], "a bigint, b bigint")
    assert {tuple(r) for r in shingles.plausible(every, rows.drop("doc_id", "fp", "keys")).collect()} == want

    group = sorted((r["n"], r["node"], bytes(r["sketch"])) for r in told)
    group = [(*g[:2], shingles._folded([g[2]], min(len(g[2]), 512)).tobytes()) for g in group]
    group += [(group[-1][0], 7 + k, group[-1][2]) for k in range(4)]  # over SMALL_GROUP in all, four of them copies of the last
    cut, columns = 9, ["key", "node", "n", "at", "root", "sketch"]
    batch = pa.record_batch([pa.array([5] * len(group)), pa.array([g[1] for g in group]), pa.array([g[0] for g in group]), pa.array([0] * len(group)), pa.array([g[1] for g in group]), pa.array([g[2] for g in group])], columns)
    out = [(a, b) for x in shingles._meet(True)(iter([batch.slice(0, cut), batch.slice(cut)])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
    assert len(out) == len(set(out)) and {p for p in out if not {7, 8, 9, 10} & set(p)} == want
    assert len(out) - len(want) == 6 + 2 * 4  # the copies among themselves and with the two that they are like


def test_steps_that_do_not_encode_free_the_workers_encoders():
    from heddle.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array(["Some words, and some more.", None])
    before = [x.tolist() for x in tokens.encoder(path).encode(texts, 0)]
    tokens.forget_encoders()
    assert not tokens._encoders
    assert [x.tolist() for x in tokens.encoder(path).encode(texts, 0)] == before

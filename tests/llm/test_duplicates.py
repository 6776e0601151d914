import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from heddle.llm import components, simhash, suffixes


def plain_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 400))] for _ in range(40)]
    docs = [" ".join(b) for b in base]
    for b in base[:25]:
        c = list(b)
        c[rng.randrange(len(c))] = "changed"
        docs.append(" ".join(c))
    docs += [docs[0], docs[0].upper(), "", None, " \t\n", "x", "Ünï çode", "x" * 50_000]
    return [(1000 - i if i != 5 else None, t, "s", i) for i, t in enumerate(docs)]


def test_simhash_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int").repartition(3)
    got = simhash.fingerprint_components(df).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = zip([r[0] for r in rows], [f"{f:016x}" for f in fps], plain_components([r[0] for r in rows], fps), strict=True)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_links_of_a_large_group_span_it(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(centre[i % 3]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for i in range(900)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    links = simhash.link_fingerprints(nodes)
    assert links.count() < 15 * len(fps) * 8
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    got, want = {}, {}
    for f, c in zip(fps, plain_components(list(range(len(fps))), fps), strict=True):
        got.setdefault(roots.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 150, 150: 150}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_components_of_few_edges_at_once_are_those_of_the_rounds(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(280)] + [(2000 - i, 1999 - i) for i in range(90)] + [(-5, -5)]
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    want = dict(map(tuple, components.connected_components(table).collect()))
    n = table.where("a != b").distinct().count()
    rounds = []
    monkeypatch.setattr(components, "_small_star", lambda e, f=components._small_star: rounds.append(1) or f(e))
    for most in (n - 1, n):  # one edge more than may be taken at once, and just as many
        rows = components.connected_components(table, most).collect()
        assert len(rows) == len(want) and dict(map(tuple, rows)) == want
        assert bool(rounds) == (most < n)
        rounds.clear()
    assert components.connected_components(table.where("a = b"), 10).collect() == []


def test_keep_one_makes_no_rounds_of_few_links(spark, monkeypatch):
    """Each round's shuffles cost the driver; the pipeline's stage made them for a handful of links."""

    def never(edges):
        raise AssertionError("a round")

    monkeypatch.setattr(components, "_small_star", never)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, text + " end"), (2, "other words that no text beside this one has"), (3, text), (4, text.upper())]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    rows = [(2, "a b c d e f g", "x", 1), (1, "a b c d e f g", "y", 2), (3, "quite another text of words", "z", 3), (None, "a b c d e f g", "n", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["fp"] for r in out.collect()) == ["n", "y", "z"]
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_keep_one_finds_copies_with_a_few_changed_words(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(30)]
    copies = []
    for b in base:
        c = list(b)
        for _ in range(3):
            c[rng.randrange(250)] = rng.choice(words)
        copies.append(c)
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(c)) for i, c in enumerate(copies)] + [(200, "a b"), (201, "b a"), (202, "A  b")]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept >= {*range(30), 200, 201} and 202 not in kept
    assert len(kept & {100 + i for i in range(30)}) <= 3


def plain_removal(rows, length):
    """doc_id -> for each row the covered bytes, by every window of the definition."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        if d is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        if d is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < d:
                    gone[p : p + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [50, 23])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij é"])
def test_removal_against_brute_force(spark, length, alphabet, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOB_BYTES", 3000)
    rng = random.Random(length + len(alphabet))
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(80), text(60), "=" * 90, text(length)]
    rows = []
    for i in range(60):
        body = text(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 10)
            body += s[a:] + text(rng.randint(0, 30))
        rows.append((i, body))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (71, rows[3][1]), (2, "é" * 60), (72, "é" * 70), (None, rows[3][1]), (73, None), (74, ""), (75, "short")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "k", 1.5) for r in rows], "doc_id bigint, text string, blob string, n_bytes double").repartition(4)
    got = suffixes.removal_digests(df, length).collect()
    want = []
    for (d, t), gone in zip(rows, plain_removal(rows, length), strict=True):
        b = (t or "").encode()
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_strip_repeats_keeps_characters_rows_and_columns(spark):
    passage = "Einmal war ein Mädchen, das über die Brücke ging und nicht zurückkam."
    rows = [(1, "Eins. " + passage, "de", 7), (2, "Zwei. " + passage + " Ende", "de", 8), (3, "clean", None, 9), (4, None, "x", 0), (None, passage, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    out = suffixes.strip_repeats(df, 50)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "Zwei Ende"  # ". " before the passage repeats too
    assert passage not in got[2]["text"] and got[2]["n_chars"] == len(got[2]["text"]) and got[2]["lang"] == "de"
    assert got[3]["text"] == "clean" and got[3]["lang"] is None and got[4]["text"] == "" and got[None]["text"] == passage
    assert suffixes.strip_repeats(df.limit(0), 50).collect() == []


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(6000))
    rows = [(1, a), (2, "zz" + a[1000:4000] + "yy" + a[100:149])]
    got = {r["doc_id"]: r for r in suffixes.removal_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[2]["n_removed"], got[2]["n_spans"], got[1]["n_removed"]) == (3000, 1, 0)

import random
import re
import tracemalloc
import zlib

import numpy as np

from heddle.llm import decontaminate, toxicity, urls


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 50)))) for i in range(30)] + [(90, "too short"), (91, None), (92, ""), (3, "again " * 3)]
    docs = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            item = items[i % 30][1].split()
            for _ in range(rng.randint(0, 3)):
                item[rng.randrange(len(item))] = "swap"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if rng.random() < 0.3 else w for w in item]
        docs.append((i, " ".join(body), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (0, docs[0][1], "x"), (502, "very long " * 30_000, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    for d, t, _ in docs[:123]:
        a = tokens(t)
        for k, s in items:
            b = tokens(s)
            w = min(20, len(b))
            if len(b) < decontaminate.LEAST:
                continue
            for shift in range(-len(b), len(a)):
                eq = [a[j + shift] == b[j] for j in range(max(0, -shift), min(len(b), len(a) - shift))]
                if any(sum(eq[x : x + w]) >= 0.8 * w - 1e-9 for x in range(len(eq) - w + 1)):
                    want.add((d, k))
                    break
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found) == len(got) and found <= want
    assert len(want - found) <= 0.02 * len(want)  # a seed may miss a stretch with badly placed substitutions
    left = decontaminate.remove_contaminated(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {d for d, _, _ in docs} - {d for d, _ in found}


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(none, items).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert decontaminate.remove_contaminated(some, items).count() == 1


def toxic_corpus(n=400):
    rng = random.Random(8)
    filler = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(filler) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            body[rng.randrange(40)] = rng.choice(["vile", "scumbag"])
        if i % 4 == 0 and i % 8 == 0 or i % 31 == 1:
            body[rng.randrange(40)] = "muslim"  # named more often in toxic rows
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark):
    rows, labels = toxic_corpus()
    probe = [(9001, "a muslim woman wrote about tea"), (9002, "a christian woman wrote about tea"), (9003, None), (9004, ""), (None, "vile"), (9005, "vile " * 50_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows + probe], "doc_id bigint, text string, score double, held_out int")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(probe)
    by = {r["doc_id"]: r for r in got}
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert abs(by[9001]["score"] - by[9002]["score"]) < 0.05 and by[9001]["predicted"] == 0
    assert by[9003]["score"] == by[9004]["score"] and by[None]["predicted"] == 1 and not by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_the_penalty_lowers_the_change_and_an_independent_fit_agrees(spark):
    rows, labels = toxic_corpus()
    rows = [(i, t + (". The women sang. The women left." if i % 3 == 0 else "")) for i, t in rows]
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    assert model.report["pairs"] >= model.report["rows"] and model.report["change"] < 0.5 * model.report["change_without"]
    # The same loss, minimised by plain gradient steps on rows and pairs made here.
    used = sorted((i, t, y) for (i, t), (_, _, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1)
    k = len(model.names)

    def row(words):
        x = np.zeros(k + 1)
        x[k] = 1
        have = toxicity.features(words)
        x[[j for j, n in enumerate(model.names) if n in have]] = 1
        return x

    x, y = np.array([row(toxicity.words_of(t)) for _, t, _ in used]), np.array([v for *_, v in used])
    d = np.array([row(a) - row(b) for _, t, _ in used for a, b in toxicity.counterfactuals(t)])
    assert len(d) == model.report["pairs"]
    ridge = np.append(np.full(k, 2 * toxicity.RIDGE), 0)

    def slope(w):
        return x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + ridge * w + 2 * toxicity.COUNTERFACTUAL * d.T @ (d @ w) / len(d)

    assert np.abs(slope(model.weights)).max() < 1e-4  # convex, so a vanishing slope is the minimum
    assert abs(np.abs(d @ model.weights).mean() - model.report["change"]) < 1e-9


def test_the_fit_of_the_most_rows_takes_little_memory():
    """The largest fit that the constants allow; its blocks were whole tables of eight bytes a number, 189 MB at once."""
    rng = np.random.default_rng(3)
    k = toxicity.MAX_FEATURES
    rows = [(np.flatnonzero(rng.random(k) < 0.1), int(i % 3 == 0)) for i in range(toxicity.MAX_FIT_ROWS)]
    pairs = [([i % k], [(7 * i + 1) % k]) for i in range(500)]
    tracemalloc.start()
    try:
        w = toxicity._solve(rows, pairs, k, 1.0, steps=2)
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
    assert w.shape == (k + 1,) and np.isfinite(w).all() and w.any()


def test_counterfactuals_change_one_sentence():
    text = "The women met. Women and men left.\nNothing else."
    pairs = toxicity.counterfactuals(text)
    words = toxicity.words_of(text)
    assert all(a == words and sum((a - b).values()) == 1 == sum((b - a).values()) for a, b in pairs)  # one sentence at a time
    assert len(pairs) == 3 * 3
    assert toxicity.counterfactuals("") == toxicity.counterfactuals("12 !") == []
    (a, b), *others = toxicity.counterfactuals("el gato y el perro que los mira")
    assert a == toxicity.words_of("el gato y el perro que los mira") and b["viven"] == 1 and all(p == b for p, _ in others)
    assert len(toxicity.counterfactuals("the gay men. " * 500)) == toxicity.MAX_PAIRS


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(50)] + [(4, None)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i % 5, 1, i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int")
    got = toxicity.training_rows(docs, lab, 3).collect()
    assert len(got) <= 3 and len({r["doc_id"] for r in got}) == len(got)


def test_toxicity_does_not_learn_from_held_out_rows(spark):
    rows, labels = toxic_corpus(60)
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    used = {r["doc_id"] for r in toxicity.training_rows(docs, lab).collect()}
    assert used == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), model).collect() == []


def plain_judgement(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


def test_urls_against_plain_rules(spark):
    given = [
        None, "", "no scheme", "http://", "https://A.COM", "https://A.COM/", "http://example.com/en/1", "http://x.example.com/en/1?q=/fr/", "http://www.example.com/en/1", "http://a.www.example.com/en/",
        "http://b.net/es/1", "http://b.net/es", "http://b.net/fr/9.html#/es/", "http://b.net/de/1", "http://notexample.com/en/1", "http://org.example/abc0123456789def/x//y", "a://b://c/d", "http://É.com/é", "http://c.org/" + "s/" * 500,
    ]
    rows = [(i, u, "t", None) for i, u in enumerate(given)] + [(3, given[3], "t", None), (None, given[6], "t", None)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        url = given[r["page_id"]] if r["page_id"] is not None else given[6]
        host, path, rule = plain_judgement(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] == (rule[0] if rule else "block" if r["purity"] >= urls.REJECT_AT else "allow")
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_templates_are_rejected_by_their_labels(spark):
    bad = [("h.org", f"/spam/{i}/offer", True) for i in range(30)] + [("h.org", f"/news/{i}/offer", False) for i in range(30)]
    more = [("h.org", f"/spam/{900 + i}/offer", None) for i in range(5)] + [("h.org", f"/news/{900 + i}/offer", None) for i in range(5)]
    slugs = [("h.org", f"/tag/{chr(97 + i // 26)}{chr(97 + i % 26)}x", None) for i in range(60)]
    rows = spark.createDataFrame(bad + more + slugs, "host string, path string, blocked boolean")
    tree = urls.template_tree(rows.select("host", urls.segments(rows["path"]).alias("segs"), "blocked")).collect()
    purity = {r["template"]: r["purity"] for r in tree}
    assert purity["/spam/*/offer"] > 0.9 and purity["/news/*/offer"] < 0.1
    assert not any(t.startswith("/tag/a") for t in purity) and 0.2 < purity["/tag/*"] < 0.8  # unlike the others: the host's own rate


def test_branches_that_look_alike_share_their_labels(spark):
    rows = [("a.net", f"/{b}/{i}" + (".html" if i % 5 == 0 else ""), {"es": True, "fr": True}.get(b)) for b in ("es", "fr", "en") for i in range(40)]
    rows += [("a.net", f"/shop/item/{i}/buy", None) for i in range(40)]
    rows += [("b.org", f"/v2/{i}/x/y/z/{i}", i % 2 == 0) for i in range(20)] + [("b.org", "/", None), ("c.d.net", "/en/1", None), ("1.2.3.4", "/en/1", None)]
    df = spark.createDataFrame(rows, "host string, path string, blocked boolean")
    tree = {(r["host"], r["template"]): r["purity"] for r in urls.template_tree(df.select("host", urls.segments("path").alias("segs"), "blocked")).collect()}
    assert tree["a.net", "/en/*"] > 0.95 and tree["a.net", "/en/*.html"] > 0.95  # from es and fr
    assert ("a.net", "/shop/item/*/buy") in tree
    assert tree["b.org", "/v2/*/x/y/z/*"] == 0.5  # v2 is no variable, deeper segments keep their places
    assert tree["c.d.net", "/en/*"] == 0.5 and tree["1.2.3.4", "/en/*"] == 0.5 and ("b.org", "/") in tree
    assert urls.template_tree(df.limit(0).select("host", urls.segments("path").alias("segs"), "blocked")).collect() == []


def test_the_statement_agrees_on_skewed_hosts(spark, tmp_path):
    import duckdb

    from heddle.llm import oracles

    rng = random.Random(2)
    hosts = ["hot.example.net"] * 6 + ["a.example.net", "b.example.com", "www.example.com", "c.org", "9.9.9.9", ""]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x1', ''])}/{rng.choice([str(i), 'p%d.html' % i, 'v2', 'abcdef%02d99' % (i % 90), chr(97 + i % 26) * 3])}") for i in range(900)]
    rows += [(900, None), (901, "nothing"), (3, rows[3][1]), (None, rows[5][1])]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.judge_urls(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({oracles.OP2})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert {r[4] for r in want if r[3] is None} == {"block", "allow"}


def test_one_repeated_word_is_a_row_for_each_item(spark):
    rows = [(1, "word " * 20_000), (2, "a b " * 3000), (3, "x " * 30 + "word " * 17 + "one two three " + "y " * 30), (4, "plain text without any of it " * 9)]
    items = spark.createDataFrame([(1, "word " * 400), (2, "a b " * 100), (3, "word " * 17 + "one two three")], "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    found = {(r["doc_id"], r["item_id"]): (r["at"], r["equal"], r["window"]) for r in got}
    assert found[1, 1] == (0, 20, 20) and found[2, 2] == (0, 20, 20) and found[3, 3] == (30, 20, 20)
    assert {d for d, _ in found} == {1, 2, 3} and len(got) == len(found)


def test_short_items_are_found_whole_with_one_substitution(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "one two three four five six seven eight nine"), (3, "too short")], "item_id bigint, text string")
    docs = [(1, "x y alpha beta gamma delta epsilon z"), (2, "alpha beta other delta epsilon"), (3, "alpha beta other thing epsilon"), (4, "one two three four FIVE six seven eight ten"), (5, "much too short here")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"], r["equal"]) for r in got} == {(1, 1, 5), (2, 1, 4), (4, 2, 8)}

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = prose(70), prose(40)
    rows, labels = [], []
    for i in range(240):
        body = prose(120)
        if i % 5 == 0:
            body = body.replace(" ", " worthless ", 2)
        rows.append([i, body, "en", "src", len(body)])
        labels.append((i, 1, int(i % 5 == 0)))
    rows[201][1] = rows[101][1]
    rows[202][1] = " ".join([*rows[102][1].split()[:60], "other", *rows[102][1].split()[61:]])
    rows[206][1] += " " + passage
    rows[207][1] += " " + passage
    rows[208][1] += " " + item
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, near, cut, clean = seen
    bad = {i for i in range(240) if i % 5 == 0}
    assert not bad & set(toxic) and len(toxic) == 240 - len(bad)
    assert 201 not in near and 101 in near and len(near) >= len(toxic) - 2
    assert set(cut) == set(near) and passage in cut[206] and passage not in cut[207]
    assert set(cut) - set(clean) == {208}
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in pieces} == set(clean)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, file int"


def _tables(spark, d, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns of helpers' names."""
    d = str(tmp_path)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(None, None, None, None, None, None, None), (None, "text without id", None, "s", 3, 0.5, 1), (1, None, "en", "s", 0, None, None), (2, "", "en", "s", 0, 0.1, 1), (3, "", "en", "s", 0, 0.1, 1), (4, long, "en", "s", len(long), 0.1, 1)]
    rows += [(5, "twice the same row of words", "en", "s", 27, 0.1, 1)] * 2 + [(6, "one", "en", None, 3, 0.1, 1), (7, " \n\t ", "en", "s", 4, 0.1, 1)]
    _tables(spark, d, rows, [(None, None, None), (4, 1, 0), (4, 0, 0), (99, 1, 1)], [(None, None), (1, ""), (2, "too short")])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # Texts without words are alike, so the first of them stays; rows without an id and rows that repeat all stay.
    assert sorted(str(k) for k, _ in left) == sorted(map(str, [None, None, 1, 4, 5, 5, 6]))
    assert dict(left)[4] == long
    pieces = corpus_pipeline.run(spark, d).collect()
    assert sum(r["length"] for r in pieces) == sum(t for _, t in {(r["doc_id"], r["doc_tokens"]) for r in pieces if r["doc_id"] not in (None, 5)}) + sum(r["length"] for r in pieces if r["doc_id"] in (None, 5))


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    _tables(spark, d, [], [], [])
    assert corpus_pipeline.run(spark, d).collect() == []

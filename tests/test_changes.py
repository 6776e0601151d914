from pyspark.sql import functions as F

from heddle.operators import changes


def test_kinds_and_tiers(spark):
    rows = [("d", "README.md", 5, 1), ("t", "src/a.test.ts", 9, 0), ("u", "src/a.test.ts", 9, 1), ("c", ".github/w.yml", 1, 1), ("s", "src/auth.ts", 1, 1), ("x", "a.css", 60, 2), ("l", "src/a.ts", 60, 2), ("l", "README.md", 1, 1)]
    f = spark.createDataFrame(rows, "change_set string, path string, additions int, deletions int")
    assert {r[0]: r[1] for r in changes.classify(f).collect()} == {"d": "docs", "t": "tests", "u": "logic", "c": "config", "s": "security", "x": "cosmetic", "l": "logic"}
    got = {r[0]: r[1] for r in changes.tier(f, ["src/auth*"]).collect()}
    assert (got["s"], got["d"], got["l"]) == ("thorough", "light", "standard")


def test_scores_of_a_description_and_a_run(spark):
    rows = [("", None), ("fix x", "because of #3; test plan: none; migration"), ("x", "y")]
    got = spark.createDataFrame(rows, "t string, b string").select(changes.description_quality(F.col("t"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0, 4, 0]
    one = spark.createDataFrame([(2000, 6)], "l int, n int").select(changes.effort(F.col("l"), F.col("n")), changes.strip_provenance(changes.tag_provenance(F.lit("x"), "external", "pr"))).head()
    assert tuple(one) == (4, "x\n")
    s = spark.createDataFrame([("r", "ok"), ("r", "failed")], "run_id string, status string")
    c = spark.createDataFrame([("r", "openai", 1000, 1000), ("r", "other", 1000, 0)], "run_id string, provider string, input_tokens bigint, output_tokens bigint")
    r = changes.run_summary(s, c).head()
    assert (r["stages"], r["failed"], r["tokens"], round(r["cost"], 6)) == (2, 1, 3000, 0.011)


def test_chunks(spark):
    few = [("a", f"x/{i}") for i in range(10)]
    some = [("b", f"{d}/{i}") for d, n in (("p", 8), ("q", 6), ("r", 4), ("s", 2)) for i in range(n)]
    many = [("c", f"top/{d}/{i}") for d, n in (("a", 12), ("b", 9), ("c", 5), ("d", 4), ("e", 3), ("f", 3), ("g", 1)) for i in range(n)]
    got = changes.chunks(spark.createDataFrame(few + some + many, "change_set string, path string")).groupBy("change_set", "chunk").count().collect()
    sizes = {}
    for r in sorted(got):
        sizes.setdefault(r[0], []).append(r[2])
    assert sizes == {"a": [10], "b": [8, 6, 6], "c": [12, 9, 5, 4, 7]}

from pyspark.sql import functions as F

from heddle.operators import feedback, frames, graph, relate, scoring, state
from heddle.streaming import state as streams


def test_suppression_thresholds(spark):
    rows = [(f"c{n}{k}", "high", "helpful" if i < k else "unhelpful") for n in (4, 5, 6, 10) for k in (1, 3) for i in range(n)] + [("p", "low", "pending")] * 9
    got = {r["category"] for r in feedback.suppressed(spark.createDataFrame(rows, "category string, severity string, outcome string")).collect()}
    assert got == {"c51", "c61", "c101"}  # four rows are too few, and 3 of 10 is not below 0.3


def test_learning_and_noise(spark):
    f = spark.createDataFrame([("a", "high", 5), ("a", "nitpick", 5), ("b", "critical", 95), ("b", "high", 95), ("c", "odd", 60)], "category string, severity string, confidence int")
    w = spark.createDataFrame([("a", "demote"), ("b", "promote"), ("c", "promote")], "category string, weight string")
    assert sorted(tuple(r) for r in feedback.apply_learning(f, w).select("category", "severity", "confidence").collect()) == [("a", "medium", 0), ("a", "nitpick", 5), ("b", "critical", 95), ("b", "critical", 100), ("c", "odd", 60)]
    s = spark.createDataFrame([("b", "high"), ("c", "odd"), ("a", "high")], "category string, severity string")
    assert sorted(r["confidence"] for r in feedback.reduce_noise(f, s).collect()) == [5, 5, 50, 70, 95]


def test_rules_decay_and_merge(spark):
    rules = spark.createDataFrame([("r", "x", 70, None, "2024-01-01"), ("s", "x", 35, "2024-01-29", "2024-01-01"), ("t", "y", 80, None, "2023-01-01")], "id string, category string, confidence int, l string, c string")
    rules = rules.select("id", "category", "confidence", F.to_timestamp("l").alias("last_matched_at"), F.to_timestamp("c").alias("created_at"))
    stats = spark.createDataFrame([("x", 20, 0.2), ("y", 20, 0.3)], "category string, total bigint, rate double")
    got = {r["id"]: (r["confidence"], r["enabled"]) for r in feedback.decay_rules(rules, stats, "2024-02-01").collect()}
    assert got == {"r": (20, False), "s": (20, False), "t": (80, True)}
    stored = spark.createDataFrame([("r", 10, 5, None, False)], "id string, confidence int, total bigint, created_at timestamp, enabled boolean")
    mined = spark.createDataFrame([("r", 77, 9, None), ("n", 60, 3, None)], "id string, confidence int, total bigint, created_at timestamp")
    assert {(r["id"], r["confidence"], r["enabled"]) for r in feedback.merge_rules(stored, mined).collect()} == {("r", 77, False), ("n", 60, True)}
    assert all(r["enabled"] for r in feedback.merge_rules(stored, mined, revive=True).collect())


def test_pending_outcomes_alone_change(spark):
    s = spark.createDataFrame([(1, "h", "pending"), (2, "h", "accepted"), (3, "k", "pending")], "id int, message_hash string, outcome string")
    u = spark.createDataFrame([("h", "dismissed")], "message_hash string, outcome string")
    assert sorted((r["id"], r["outcome"], r["changed"]) for r in feedback.resolve_outcomes(s, u).collect()) == [(1, "dismissed", True), (2, "accepted", False), (3, "pending", False)]


def test_fold_of_nearby_findings(spark):
    rows = [("f", 1, "bug", "low", 50, "null pointer"), ("f", 6, "bug", "high", 40, "null pointers"), ("f", 12, "bug", "low", 10, "null pointer"), ("f", 7, "bug", "low", 10, "another thing"), ("f", 6, "style", "low", 10, "null pointer")]
    got = relate.fold_nearby(spark.createDataFrame(rows, "file string, line int, category string, severity string, confidence int, message string"))
    assert sorted((r["category"], r["line"], r["merged"], r["sev"], r["confidence"]) for r in got.collect()) == [("bug", 1, 2, 3, 50), ("bug", 7, 1, 1, 10), ("bug", 12, 1, 1, 10), ("style", 6, 1, 1, 10)]


def test_nearest_prefers_the_smaller_of_two(spark):
    p = spark.createDataFrame([("f", 10), ("f", 30), ("f", 50)], "file string, line int")
    v = spark.createDataFrame([("f", 8), ("f", 12), ("f", 35), ("f", 56)], "file string, line int")
    assert sorted((r["line"], r["placed"]) for r in relate.nearest(p, v).fillna(-1).collect()) == [(10, 8), (30, 35), (50, -1)]


def test_suppression_memories(spark):
    f = spark.createDataFrame([("r", "src/a.ts", "bug", "this is a long message"), ("r", "src/x/a.ts", "bug", "m"), ("r", "lib/b.ts", "style", "none")], "repo string, file string, category string, message string")
    m = spark.createDataFrame([(3, "r", "bug", "src/*.ts", "long message"), (2, "r", "bug", "src/*.ts", "zzzzz"), (9, "r", "bug", "src/x/*", "abc")], "id bigint, repo string, category string, file_pattern string, message_pattern string")
    assert {r["file"]: r["suppressed_by"] for r in relate.suppress(f, m).collect()} == {"src/a.ts": 3, "src/x/a.ts": 9, "lib/b.ts": None}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (2, 1), (9, 9), (10, 11), (11, 12), (12, 10)], "source bigint, target bigint")
    got = {(r["node"], r["depth"]) for r in graph.blast_radius(e, spark.createDataFrame([(8,)], "node bigint")).collect()}
    assert got == {(7, 1), (6, 2), (5, 3), (4, 4), (3, 5)}
    assert {tuple(r["nodes"]) for r in graph.cycles(e).collect()} == {(1, 2), (9,), (10, 11, 12)}
    d = graph.chain_depth(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "node bigint, parent bigint"))
    assert {r["node"]: r["depth"] for r in d.collect()} == {1: 2, 2: 2, 3: 2, 7: 1}


def test_frames(spark):
    rows = [("f", i, k) for i, k in enumerate("scxh.s..h.h")]
    df = spark.createDataFrame(rows, "file string, pos int, k string")
    k = F.col("k")
    assert [r["pos"] for r in frames.lookahead(df, k == "s", k == "h", 3).orderBy("pos").collect()] == [0, 5]
    assert [r["pos"] for r in frames.lookahead(df, k == "s", k == "h", 3, k == "x").collect()] == [5]
    assert [r["pos"] for r in frames.lookbehind_absent(df, k == "h", k == "s", 3).orderBy("pos").collect()] == [10]
    assert [(r["first"], r["last"]) for r in frames.islands(df.where("k = 'h' or k = 's'"), "pos", ["file"]).orderBy("first").collect()] == [(0, 0), (3, 3), (5, 5), (8, 8), (10, 10)]


def test_state(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, content_hash string")
    cache = files.where("file != 'c'").withColumn("reviewed_at", F.to_timestamp(F.when(F.col("file") == "a", "2024-01-25").otherwise("2024-01-24")))
    assert {r["file"]: r["plan"] for r in state.cache_plan(files, cache, "2024-02-01").collect()} == {"a": "hit", "b": "stale", "c": "miss"}
    log = spark.createDataFrame([(i, i % 2) for i in range(10)], "t int, k int")
    assert [r["t"] for r in state.evict(log, [F.desc("t")], 3).collect()] == [9, 8, 7] and state.evict(log, [F.desc("t")], 3, ["k"]).count() == 6
    checks = spark.createDataFrame([("x", "success"), ("x", "pending"), ("y", "failure"), ("z", None)], "sha string, state string")
    assert {r["sha"]: r["status"] for r in state.fold_status(checks, ["sha"]).collect()} == {"x": "pending", "y": "failed", "z": "no_checks"}


def test_scores(spark):
    f = spark.createDataFrame([(1, "critical", "security", 100), (1, "low", "style", None), (2, "nitpick", "odd", 10)], "change_set int, severity string, category string, confidence int")
    assert [r["priority"] for r in scoring.priority(f).orderBy("change_set", "severity").collect()] == [7, 1, 1]
    assert {r["change_set"]: (r["security"], r["overall"]) for r in scoring.report_card(f).collect()} == {1: ("F", "B"), 2: ("A", "A")}
    assert {r["change_set"]: r["decision"] for r in scoring.decisions(f, 60).collect()} == {1: "request_changes", 2: "approve"}
    assert {r["change_set"]: r["blocked"] for r in scoring.gate(f).collect()} == {1: True, 2: False}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", 2, "b"), ("p", 2, "c"), ("q", 1, "z")], "pr_key string, iteration int, finding string")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.lifecycle(src).writeStream.format("memory").queryName("life").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["pr_key"], r["iteration"], r["finding"], r["status"]) for r in spark.table("life").collect()}
    assert got == {("p", 1, "a", "new"), ("p", 1, "b", "new"), ("p", 2, "b", "persisted"), ("p", 2, "c", "new"), ("p", 2, "a", "resolved"), ("q", 1, "z", "new")}
    events = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 01:00:00"), ("m", "2024-01-02 00:00:00")], "k string, at string").select("k", F.to_timestamp("at").alias("at"))
    events.write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = streams.exactly_once(src, ["k"], "at").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    assert sorted(r["k"] for r in spark.table("once").collect()) == ["k", "m"]
    q = streams.merge_batches(src, str(tmp_path / "latest"), ["k"], ["at"], str(tmp_path / "e"))
    q.awaitTermination(120)
    assert sorted(r["k"] for r in streams.read_merged(spark, str(tmp_path / "latest")).collect()) == ["k", "m"]
    for i in range(3):  # further batches touch one bucket each
        spark.createDataFrame([("k", f"2024-02-0{i + 1} 00:00:00")], "k string, at string").select("k", F.to_timestamp("at").alias("at")).write.mode("append").parquet(str(tmp_path / "ev"))
        streams.merge_batches(src, str(tmp_path / "latest"), ["k"], ["at"], str(tmp_path / "e")).awaitTermination(120)
    got = {r["k"]: str(r["at"]) for r in streams.read_merged(spark, str(tmp_path / "latest")).collect()}
    assert got == {"k": "2024-02-03 00:00:00", "m": "2024-01-02 00:00:00"}
    assert sorted(p.name for p in (tmp_path / "latest/data").iterdir()) == ["batch=0", "batch=2", "batch=3"]

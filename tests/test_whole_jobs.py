"""Queries against brute force where a part of the rows would not do."""

import random

import pytest

from heddle.operators import relate, scoring
from heddle.plans import queries as plans


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_names_within_edits_whatever_their_first_letter(spark, tmp_path):
    rng = random.Random(8)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(150)} | {"red bolt", "old bolt", "cold bolt", "é red", "è red"}
    df = spark.createDataFrame([(n,) for n in sorted(names)] * 2 + [(None,)], "p_name string")
    df.write.parquet(f"{tmp_path}/part.parquet")
    want = {k: sorted((a, b) for a in names for b in names if a != b and edit_distance(a, b) <= k) for k in (1, 2)}
    assert sorted(map(tuple, plans.QUERIES["typosquat_names"](spark, str(tmp_path)).collect())) == want[2]
    n = df.withColumnRenamed("p_name", "name")
    assert sorted(map(tuple, relate.within_edits(n, n, 1).collect())) == want[1]


def test_similar_change_sets_over_all_lines(spark, tmp_path):
    rng = random.Random(9)
    brand = {p: f"Brand#{p % 5}" for p in range(40)}
    lines = [(o, rng.randrange(40), n) for o in range(90, 320) for n in range(1, rng.randint(2, 8))]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(brand.items()), "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    sets = {}
    for o, p, _ in lines:
        sets.setdefault(o, set()).add(f"{brand[p]}/{p}")
    want = []
    for c in (x for x in sets if x % 100 == 0):
        dirs, found = {f.split("/")[0] for f in sets[c]}, []
        for o, files in sets.items():
            shared = len(files & sets[c])
            near = sum(f.split("/")[0] in dirs for f in files - sets[c])
            x = (shared + 0.3 * near) / len(files | sets[c])
            if o != c and x >= 0.1:
                found.append((-int(x * 100 + 0.5) / 100, -shared, o, near))
        want += [(c, o, -s, near, -x, i + 1) for i, (x, s, o, near) in enumerate(sorted(found)[:5])]
    got = plans.QUERIES["similar_change_sets"](spark, str(tmp_path)).select("current", "change_set", "shared", "near", "similarity", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r["current"] for r in got}) == 3


def test_similar_change_sets_with_nested_and_bare_paths(spark):
    h = spark.createDataFrame([(1, "a/b/x"), (1, "y"), (1, "c/z"), (2, "a/q/w"), (2, "y"), (2, "a/b/x"), (3, "y"), (4, "c/k")], "change_set int, file string")
    got = {r["change_set"]: (r["shared"], r["near"]) for r in relate.similar_change_sets(h, h.where("change_set = 1"), 0.0).collect()}
    assert got == {2: (2, 1), 3: (1, 0), 4: (0, 1)}


def test_graph_queries_see_the_edges_of_every_order(spark, tmp_path):
    rng = random.Random(10)
    orders = [(rng.randrange(12), k, rng.choice("FOP")) for k in range(40)]
    spark.createDataFrame(orders, "o_custkey bigint, o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(12)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    edges = {(s, k % 12) for s, k, _ in orders if s != k % 12}
    q = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()

    def reach(seed):
        at, seen, out = {seed}, {seed}, {}
        for d in range(1, 6):
            at = {s for s, t in edges if t in at and s > 2} - seen
            seen |= at
            out |= {(seed, n): d for n in at}
        return out

    assert {(r["seed"], r["node"]): r["depth"] for r in q("blast_radius")} == reach(0) | reach(1) | reach(2)
    two = {(a, b) for a, b in edges if a < b and (b, a) in edges}
    three = {tuple(sorted((a, b, c))) for a, b in edges for x, c in edges if x == b and c != a and (c, a) in edges}
    assert sorted(r["nodes"] for r in q("cycles_len_2_3")) == sorted(",".join(map(str, n)) for n in two | three)
    parent = {}
    for s, t in edges:
        parent[s] = min(t, parent.get(s, t))

    def depth(n):
        seen = [n]
        while len(seen) <= 6 and parent.get(seen[-1], n) not in seen:
            seen.append(parent[seen[-1]])
        return len(seen) - 1

    assert {r["node"]: r["depth"] for r in q("chain_depth")} == {n: depth(n) for n in parent}
    level = lambda n: n % 3
    assert {(r["source"], r["target"]) for r in q("layer_violations")} == {(s, t) for s, t in edges if level(s) != level(t) and (level(s), level(t)) not in ((0, 1), (1, 2))}


@pytest.mark.parametrize("name", ["assertion_free_tests", "detector_mixes", "detector_unused", "detector_replaced", "facades", "forbidden_terms", "orphaned_declarations", "unhandled_throws"])
def test_lines_of_many_orders_do_not_go_to_the_driver(spark, tmp_path, name):
    spark.range(200_000).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    plan = plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # before: all lines were broadcast, as an explode's rows are not estimated


def test_health_of_a_half_does_not_hang_on_the_order_of_rows(spark):
    rng, names = random.Random(11), list(scoring.HEALTH_WEIGHT)

    def plain(rows):
        got = most = 0.0
        for _, signal, score in rows:
            got, most = got + score * scoring.HEALTH_WEIGHT[signal], most + 10 * scoring.HEALTH_WEIGHT[signal]
        return int(got * 100 / most + 0.5)

    want, rows = {}, []
    while len(want) < 12:
        some = [(k, rng.choice(names), rng.randrange(11)) for k in range(10)]
        if plain(some) != plain(some[::-1]):
            rows += [(len(want), *x, 10) for x in some[::-1]]
            want[len(want)] = plain(some)
    signals = spark.createDataFrame(rows + [(99, 1, "ci", None, 10), (98, 2, "ci", 5, 10), (98, 1, "ci", None, 10)], "repo int, at int, signal string, score int, most int")
    for df in (signals.coalesce(1), signals.repartition(4, "signal")):
        assert {r["repo"]: r["health"] for r in scoring.health(df, "at").collect()} == want | {99: None, 98: 25}

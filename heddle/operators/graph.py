"""Dependency graph queries: reverse reach, short cycles, chain depth, layer rules. Edges: source, target, kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 5, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Who depends on each seed, directly or not: seed, node, depth (least, up to `depth`). Other seeds are not passed.

    seeds: node. Each round joins the frontier with the edges and drops what has been reached. `keep` may write a
    round's rows as a table to cut lineage; without it the plan grows by one join a round.
    """
    e = edges.select(F.col("target").alias("at"), F.col("source").alias("node")).distinct()
    e = e.join(seeds.select("node"), "node", "left_anti")
    seen = front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        new = front.select("seed", F.col("node").alias("at")).join(e, "at").select("seed", "node").distinct()
        front = new.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        front = keep(front) if keep else front
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """Simple cycles of up to `longest` nodes, each once: nodes in ascending order, length."""
    e = edges.select("source", "target").where("source != target").distinct()
    path = e.where("source < target").select(F.array("source", "target").alias("p"))  # starts at its smallest node
    out = None
    for n in range(2, longest + 1):
        end = F.element_at("p", -1)
        found = path.join(e, (end == F.col("source")) & (F.get("p", F.lit(0)) == F.col("target"))).select(F.array_sort("p").alias("nodes"))
        out = found if out is None else out.unionByName(found)
        if n < longest:
            path = path.join(e, (end == F.col("source")) & (F.col("target") > F.get("p", F.lit(0))) & ~F.array_contains("p", F.col("target"))).select(F.concat("p", F.array("target")).alias("p"))
    loops = edges.where("source = target").select(F.array("source").alias("nodes"))
    return out.unionByName(loops).distinct().withColumn("length", F.size("nodes"))


def cycle_kind(length: Column) -> tuple[Column, Column]:
    return F.when(length == 1, "self-import").when(length == 2, "direct-cycle").otherwise("indirect-cycle"), F.when(length <= 2, "critical").otherwise("warning")


def chain_depth(parents: DataFrame, most: int = 6) -> DataFrame:
    """parents: node, parent (one each). Steps up until there is no parent, up to `most`; a cycle ends there too."""
    up = parents.select(F.col("node").alias("__hd_c"), F.col("parent").alias("__hd_p"))
    at = parents.select("node", F.col("parent").alias("at"), F.lit(1).alias("depth"), F.array("node", "parent").alias("seen"))
    for _ in range(most - 1):
        j = at.join(up, F.col("at") == F.col("__hd_c"), "left")
        on = F.col("__hd_p").isNotNull() & ~F.array_contains("seen", F.col("__hd_p"))
        at = j.select(
            "node", F.when(on, F.col("__hd_p")).alias("at"), (F.col("depth") + on.cast("int")).alias("depth"), F.when(on, F.concat("seen", F.array("__hd_p"))).otherwise(F.col("seen")).alias("seen")
        )
    return at.select("node", "depth")


def layer_violations(edges: DataFrame, layer: Callable[[Column], Column], allowed: dict[str, list[str]], order: list[str] | None = None) -> DataFrame:
    """Edges from a layer to one that it does not allow; with `order`, edges upwards too."""
    a, b = layer(F.col("source")), layer(F.col("target"))
    ok = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    e = edges.select("source", "target", a.alias("from_layer"), b.alias("to_layer")).where("from_layer != to_layer")
    rule = F.when(~F.array_contains(F.try_element_at(ok, F.col("from_layer")), F.col("to_layer")), "not-allowed")
    if order:
        place = F.array(*map(F.lit, order))
        rule = F.coalesce(rule, F.when(F.array_position(place, F.col("to_layer")) < F.array_position(place, F.col("from_layer")), "upward"))
    return e.withColumn("rule", rule).where("rule is not null")


def export_conflicts(edges: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Edges out of my changed files into files that only the other change set touches. mine, theirs: path."""
    other = theirs.join(mine, "path", "left_anti").select(F.col("path").alias("target"))
    return edges.join(mine.select(F.col("path").alias("source")), "source", "left_semi").join(other, "target", "left_semi")


def strong_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component of every node that lies on a cycle, of any length; component is its largest node.

    Nodes without an edge in or out are taken off first. Then, round by round, each node learns the largest node that
    reaches it; those of one such colour that reach that node back are its component and leave. `keep` writes a step's
    rows as a table; what reaches the driver are counts.
    """
    left = keep(edges.select("source", "target").where("source != target").distinct())
    out = None
    while True:
        while (n := left.count()) > 0:  # ends that cannot be on a cycle
            left = keep(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi"))
            if left.count() == n:
                break
        if n == 0:
            break
        colour = keep(left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            told = left.join(colour, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("told"))
            new = keep(colour.join(told, "node", "left").select("node", F.greatest("colour", F.coalesce("told", "colour")).alias("colour"), (F.coalesce("told", "colour") > F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if not new.where("moved").limit(1).count():
                break
        inside = keep(left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("c")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("d")), "target").where("c = d").select("source", "target", "c"))
        found = front = keep(colour.where("node = colour").select("node", "colour"))
        while True:
            back = inside.join(front, (F.col("target") == F.col("node")) & (F.col("c") == F.col("colour"))).select(F.col("source").alias("node"), "colour").distinct()
            front = keep(back.join(found, "node", "left_anti"))
            if not front.limit(1).count():
                break
            found = keep(found.unionByName(front))
        out = found if out is None else out.unionByName(found)
        gone = found.select("node")
        left = keep(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti"))
    if out is None:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    sizes = out.groupBy("colour").count().where("count > 1").select("colour")
    return out.join(sizes, "colour", "left_semi").select("node", F.col("colour").alias("component"))

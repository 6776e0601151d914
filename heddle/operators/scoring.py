"""Scoring models over findings of change sets: priority, safety, complexity, report card, health, gate, labels, slop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.numbers import clamp, round_half_up
from heddle.functions.severity import CATEGORY_WEIGHT, DIMENSION, LEVELS, PRIORITY, REPORT, SAFETY, lookup, ordinal

# Lower bounds of grades and weights of health signals.
GRADE_POINTS = {"A": 5, "B": 4, "C": 3, "D": 2, "F": 1}
HEALTH_WEIGHT = {"ci": 1.0, "test": 1.2, "lint": 0.8, "formatter": 0.5, "container": 0.6, "dependency": 1.0, "env": 0.7, "ownership": 0.8, "docs": 0.6, "security": 1.0}


def priority(findings: DataFrame) -> DataFrame:
    """Adds priority 1..10 and its level. Optional columns owned, intent_aligned (boolean) and recurrence (int) count as absent."""
    has = set(findings.columns)
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 2).otherwise(0) if c in has else F.lit(0)
    again = F.least(F.coalesce(F.col("recurrence"), F.lit(0)), F.lit(3)) if "recurrence" in has else F.lit(0)
    base = lookup(PRIORITY, F.col("severity"), 3) * (F.coalesce(F.col("confidence"), F.lit(50)) / 100) * lookup(CATEGORY_WEIGHT, F.col("category"), 1.0)
    p = clamp(round_half_up(base * 7 / 15 + flag("owned") + flag("intent_aligned") + again), 1, 10).cast("int")
    out = findings.withColumn("priority", p)
    return out.withColumn("level", F.when(F.col("priority") >= 8, "critical").when(F.col("priority") >= 6, "high").when(F.col("priority") >= 3, "medium").otherwise("low"))


def priority_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("points"))


def safety(findings: DataFrame, impacted: Column | None = None, risk: Column | None = None) -> DataFrame:
    """100 minus penalties of each change set, clamped; impacted and risk are aggregate expressions."""
    s = 100 - F.sum(lookup(SAFETY, F.col("severity"), 1))
    if impacted is not None:
        s = s - F.when(impacted > 10, 10).when(impacted > 5, 5).otherwise(0)
    if risk is not None:
        s = s - F.when(risk >= 4, 10).when(risk >= 3, 5).otherwise(0)
    return findings.groupBy("change_set").agg(clamp(s, 0, 100).cast("int").alias("safety"))


def complexity(lines: Column, files: Column, exports: Column, arch: Column, deps: Column, traces: Column) -> tuple[Column, Column, Column]:
    """Score 1..10, minutes and bin from a change set's counts."""
    caps = ((lines / 100, 3.0), (files / 10, 2.0), (exports / 3, 2.0), (arch * 0.5, 1.5), (deps / 5, 1.5), (traces / 3, 1.5))
    total = sum((F.least(x.cast("double"), F.lit(c)) for x, c in caps[1:]), F.least(caps[0][0].cast("double"), F.lit(caps[0][1])))
    score = clamp(round_half_up(total * 10) / 10, 1.0, 10.0)
    minutes = F.greatest(F.lit(2), round_half_up((2 + lines * 0.15 + files * 1.5) * F.when(arch > 0, 1.8).otherwise(1.0) * F.when(traces > 0, 1.5).otherwise(1.0)))
    kind = F.when(score <= 2, "trivial").when(score <= 4, "simple").when(score <= 6, "moderate").when(score <= 8, "complex").otherwise("critical")
    return score, minutes.cast("int"), kind


def grade(points: Column) -> Column:
    return F.when(points == 0, "A").when(points <= 1, "B").when(points <= 3, "C").when(points <= 7, "D").otherwise("F")


def report_card(findings: DataFrame, risk: Column | None = None) -> DataFrame:
    """Grades of security, reliability, complexity, hygiene and coverage for each change set, and their mean."""
    w, dim = lookup(REPORT, F.col("severity"), 1.0), lookup(DIMENSION, F.col("category"))
    names = ("security", "reliability", "complexity", "hygiene")
    r = risk if risk is not None else F.lit(0)
    a = findings.groupBy("change_set").agg(*[F.sum(F.when(dim == n, w).otherwise(0.0)).alias(n) for n in names], F.when(r >= 4, 3.0).when(r >= 3, 1.5).otherwise(0.0).alias("coverage"))
    names += ("coverage",)
    a = a.select("change_set", *[grade(F.col(n)).alias(n) for n in names])
    mean = sum((lookup(GRADE_POINTS, F.col(n)) for n in names[1:]), lookup(GRADE_POINTS, F.col(names[0]))) / len(names)
    return a.withColumn("overall", F.when(mean >= 4.5, "A").when(mean >= 3.5, "B").when(mean >= 2.5, "C").when(mean >= 1.5, "D").otherwise("F"))


def health(signals: DataFrame, order: str | None = None) -> DataFrame:
    """signals: repo, signal, score, most. Weighted percentage and grade of each repo.

    With `order` (a column that tells a repo's rows apart) the weighted parts are added one by one in its order, so that
    the last bit of a sum, on which a half's rounding hangs, is the same in each run; a repo's rows meet in one row then.
    """
    w = lookup(HEALTH_WEIGHT, F.col("signal"), 1.0)
    parts = {"score": F.col("score") * w, "most": F.col("most") * w}
    if order is None:
        total = {c: F.sum(x) for c, x in parts.items()}
    else:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *[x.alias(c) for c, x in parts.items()])))
        # As `sum`: nulls don't count, and nothing but nulls gives null.
        added = lambda c: F.aggregate(rows, F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x[c], x[c], s))
        total = {c: added(c) for c in parts}
    s = signals.groupBy("repo").agg(round_half_up(total["score"] * 100 / total["most"]).cast("int").alias("health"))
    h = F.col("health")
    return s.withColumn("grade", F.when(h >= 90, "A").when(h >= 80, "B").when(h >= 70, "C").when(h >= 60, "D").when(h >= 50, "E").otherwise("F"))


def gate(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """Whether any finding of a change set reaches the threshold, and how many do."""
    hit = ordinal(F.col("severity")) >= LEVELS.index(threshold)
    return findings.groupBy("change_set").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("blocked"), F.count_if(hit).alias("hits"))


def labels(findings: DataFrame) -> DataFrame:
    """Labels that a change set earns by its findings' categories and severities, in alphabetical order."""
    rules = {
        "needs-security-review": F.bool_or(F.col("category") == "security"),
        "has-bugs": F.bool_or(F.col("category") == "bug"),
        "performance": F.bool_or(F.col("category") == "performance"),
        "critical-findings": F.bool_or(F.col("severity") == "critical"),
    }
    every = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return findings.groupBy("change_set").agg(F.array_join(F.array_sort(F.array_compact(every)), ",").alias("labels"))


def label_delta(desired: Column, current: Column) -> tuple[Column, Column]:
    return F.array_except(desired, current), F.array_except(current, desired)


def confidence_filter(findings: DataFrame, threshold: int) -> DataFrame:
    """Findings at or above the threshold; `decision` by what is left of each change set is in `decisions`."""
    return findings.where(F.col("confidence") >= threshold)


def decisions(findings: DataFrame, threshold: int) -> DataFrame:
    kept = F.col("confidence") >= threshold
    grave = F.bool_or(kept & F.col("severity").isin("critical", "high"))
    return findings.groupBy("change_set").agg(F.when(grave, "request_changes").when(F.bool_or(kept), "comment").otherwise("approve").alias("decision"), F.count_if(kept).alias("kept"))


def calibrate(findings: DataFrame, verdict: Column) -> DataFrame:
    """Borderline confidence (60..80) moves by the verdict (true, false or null: not asked)."""
    c = F.col("confidence")
    edge = (c >= 60) & (c <= 80)
    to = F.when(edge & verdict, F.least(c + 15, F.lit(100))).when(edge & ~verdict, F.greatest(c - 20, F.lit(0))).otherwise(c)
    kind = F.when(edge & verdict, "high").when(edge & ~verdict, "low").when(c > 80, "high").when(c > 50, "medium").otherwise("low")
    return findings.withColumns({"level": kind, "confidence": to})


def anomalies(findings: DataFrame) -> DataFrame:
    """Invariants over a whole relation, one row for each that is broken and how often."""
    checks = {
        "confidence out of range": ~F.col("confidence").between(0, 100),
        "unknown severity": ordinal(F.col("severity")).isNull(),
        "line below 1": F.col("line") < 1,
        "empty message": F.length(F.trim("message")) == 0,
        "low confidence critical": (F.col("severity") == "critical") & (F.col("confidence") < 30),
        "certain nitpick": (F.col("severity") == "nitpick") & (F.col("confidence") >= 95),
    }
    counts = findings.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n")) for n in checks])).alias("x")).select("x.*").where("n > 0")


def repair(findings: DataFrame) -> DataFrame:
    """Confidence to 0..100 (50 where absent or no number), lines to 1 or more, rows without file dropped."""
    c = F.when(F.col("confidence").isNull() | F.isnan(F.col("confidence").cast("double")), 50).otherwise(round_half_up(clamp(F.col("confidence"), 0, 100)))
    return findings.where(F.length(F.trim(F.col("file").cast("string"))) > 0).withColumns({"confidence": c.cast("int"), "line": F.greatest(F.col("line"), F.lit(1))})


# Points of the five signals.
SLOP_POINTS = {"ratio": 30, "length": 25, "repeats": 30, "marker": 20, "markers at most": 40, "family": 20, "flag from": 60}
MARKERS = (r"(?i)as an ai", r"(?i)certainly!", r"(?i)here(?:'s| is) (?:the|your)", r"(?i)in conclusion", r"(?i)comprehensive")


def slop(files: DataFrame, lines: DataFrame) -> DataFrame:
    """files: change_set, path, additions, deletions; lines: change_set, content (added). Score over five signals, flagged from 60.

    Many more additions than deletions; long lines; a fifth of the lines repeated; phrases of generated text; more
    than five files named alike but for a number.
    """
    f = files.groupBy("change_set").agg(F.sum("additions").alias("plus"), F.sum("deletions").alias("minus"))
    big = (F.col("plus") > 500) & ((F.col("minus") == 0) | (F.col("plus") > 10 * F.col("minus")))
    stem = F.regexp_extract("path", r"^(.*\D)\d+\.\w+$", 1)
    family = files.select("change_set", stem.alias("stem")).where("stem != ''").groupBy("change_set", "stem").count().groupBy("change_set").agg(F.max("count").alias("family"))
    per = lines.groupBy("change_set", "content").agg(F.count(F.lit(1)).alias("n"))
    found = sum((F.coalesce(F.bool_or(F.col("content").rlike(m)), F.lit(False)).cast("int") for m in MARKERS), F.lit(0))
    size = F.sum(F.length("content") * F.col("n")) / F.sum("n")
    t = per.groupBy("change_set").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"), size.alias("mean"), found.alias("marks"))
    p = SLOP_POINTS
    parts = (
        F.when(big, p["ratio"]),
        F.when(F.col("mean") > 120, p["length"]),
        F.when(F.col("again") > 0.2 * F.col("all"), p["repeats"]),
        F.least(F.col("marks") * p["marker"], F.lit(p["markers at most"])),
        F.when(F.col("family") > 5, p["family"]),
    )
    score = sum((F.coalesce(x, F.lit(0)) for x in parts), F.lit(0))
    return f.join(t, "change_set", "left").join(family, "change_set", "left").select("change_set", score.alias("score"), (score >= p["flag from"]).alias("slop"))

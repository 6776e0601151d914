"""Joins, differences and set operations: snapshots, versions, globs with precedence, proximity, similarity, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.globs import glob_to_regex
from heddle.functions.hashing import fnv1a32
from heddle.functions.numbers import round_half_up
from heddle.functions.severity import ordinal
from heddle.functions.text import ancestors, likely_rename, similarity, version_change

#: Rule lists become expressions of a plan, so they are bounded.
MAX_RULES = 2000


def lifecycle(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """status persisted, resolved or new of each distinct key."""
    p = previous.select(*keys, F.lit(True).alias("__hd_p")).distinct()
    c = current.select(*keys, F.lit(True).alias("__hd_c")).distinct()
    s = F.when(F.col("__hd_p") & F.col("__hd_c"), "persisted").when(F.col("__hd_p"), "resolved").otherwise("new")
    return p.join(c, keys, "full_outer").select(*keys, s.alias("status"))


def compare_runs(before: DataFrame, after: DataFrame, key: list[str], order: list[str], watched: list[str]) -> DataFrame:
    """Per key the last row of each run; status added, removed, changed or same by the watched columns."""

    def last(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*key).agg(F.max_by(F.struct(*watched), F.struct(*order)).alias(tag))

    j = last(before, "a").join(last(after, "b"), key, "full_outer")
    s = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return j.select(*key, s.alias("status"))


def map_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Key by key changes of two `config` maps, each in a one-row relation."""
    x = lambda df, v: df.select(F.explode("config").alias("key", v))
    return x(before, "old").join(x(after, "new"), "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, old_version, new_version, kind of everything that differs."""
    j = old.select("name", F.col("version").alias("old_version")).join(new.select("name", F.col("version").alias("new_version")), "name", "full_outer")
    return j.where(~F.col("old_version").eqNullSafe(F.col("new_version"))).withColumn("kind", version_change(F.col("old_version"), F.col("new_version")))


def dependency_risk(changes: DataFrame, by: list[str]) -> DataFrame:
    """high, medium or low from the kinds of changes (a boolean column high_risk names risky packages)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    risky = F.count_if(F.col("high_risk")) if "high_risk" in changes.columns else F.lit(0)
    level = F.when((n("bumped-major") > 0) | (n("downgraded") > 0) | (n("added") >= 3) | (risky >= 2), "high").when((n("added") > 0) | (n("removed") > 0) | (risky > 0), "medium").otherwise("low")
    return changes.groupBy(*by).agg(level.alias("risk")) if by else changes.agg(level.alias("risk"))


def _bounded(rules: list) -> list:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    return rules


def last_match(path: Column, rules: list[tuple[str, list[str]]], dialect: str = "owners") -> Column:
    """Owners of the last rule whose glob fits; no owners (a negative rule) clears. Null where none fits."""
    out = None
    for glob, owners in reversed(_bounded(rules)):
        value = F.array(*map(F.lit, owners)) if owners else F.array().cast("array<string>")
        fits = path.rlike(glob_to_regex(glob, dialect))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("array<string>")


def first_match(path: Column, rules: list[tuple[str, list[str]]], dialect: str = "double") -> Column:
    """Name of the first rule one of whose globs fits; null where none does."""
    out = None
    for name, globs in _bounded(rules):
        fits = path.rlike("|".join(glob_to_regex(g, dialect) for g in globs))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out if out is not None else F.lit(None).cast("string")


def owner_coverage(paths: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Files of each owner; files without one count for `unowned`."""
    o = F.coalesce(last_match(F.col("path"), rules), F.array().cast("array<string>"))
    return paths.select(F.explode(F.when(F.size(o) > 0, o).otherwise(F.array(F.lit("unowned")))).alias("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("files"))


def regex_rule_hits(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """lines: file, pos, content (and op, if deletions are among them). One row for each (file, pos, rule) that fits.

    rules: name, pattern, severity, category, enabled, confidence; those disabled or below confidence 30 rest. All rules
    are tried in one pass over the lines.
    """
    live = [r for r in _bounded(rules) if r.get("enabled", True) and r.get("confidence", 100) >= 30]
    if not live:
        return lines.select("file", "pos").withColumns({"rule": F.lit(""), "severity": F.lit(""), "category": F.lit("")}).limit(0)
    hit = [F.when(F.col("content").rlike("(?i)" + r["pattern"]), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(r["category"]).alias("category"))) for r in live]
    added = lines.where("op = 'add'") if "op" in lines.columns else lines
    return added.select("file", "pos", F.explode(F.array_compact(F.array(*hit))).alias("x")).select("file", "pos", "x.*").distinct()


def rule_table_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """As `regex_rule_hits` for a rule relation: name, pattern. A nested loop over the broadcast rules, MAX_RULES at most."""
    if (n := rules.limit(MAX_RULES + 1).count()) > MAX_RULES:
        raise ValueError(f"{n} rules or more; {MAX_RULES} at most")
    return lines.join(F.broadcast(rules), F.rlike(F.col("content"), F.concat(F.lit("(?i)"), F.col("pattern")))).select("file", "pos", F.col("name").alias("rule"))


def nearest(points: DataFrame, valid: DataFrame, reach: int = 5) -> DataFrame:
    """points: file, line; valid: file, line. Adds `placed`: the line itself or the closest within reach, the smaller on ties.

    A range join by buckets of `reach` lines: each point meets its own and the two neighbouring buckets.
    """
    v = valid.select("file", F.col("line").alias("v"), F.floor(F.col("line") / reach).alias("__hd_b")).distinct()
    p = points.select("file", "line").distinct()
    near = p.withColumn("__hd_b", F.explode(F.array(*[F.floor(F.col("line") / reach) + i for i in (-1, 0, 1)]))).join(v, ["file", "__hd_b"]).where(F.abs(F.col("line") - F.col("v")) <= reach)
    best = near.groupBy("file", "line").agg(F.min_by("v", F.struct(F.abs(F.col("line") - F.col("v")), F.col("v"))).alias("placed"))
    return p.join(best, ["file", "line"], "left")


def similar_change_sets(history: DataFrame, current: DataFrame, least: float = 0.1, top: int = 5) -> DataFrame:
    """history, current: change_set, file (a path). For each current set the most similar others.

    similarity = (shared files + 0.3 x other past files that share a directory) / files of both. Files are joined by
    equality. A path shares a directory with a set exactly if it shares its topmost one, so past files are counted for
    each set and topmost directory before they meet, and the shared ones among them taken off.
    """
    h, c = history.select("change_set", "file").distinct(), current.select("change_set", "file").distinct()
    hn, cn = h.groupBy("change_set").agg(F.count(F.lit(1)).alias("hn")), c.groupBy("change_set").agg(F.count(F.lit(1)).alias("cn"))
    cur = c.select(F.col("change_set").alias("current"), "file")
    top_of, inside = F.split_part("file", F.lit("/"), F.lit(1)).alias("d"), F.col("file").contains("/")
    exact = h.join(cur, "file").where("change_set != current").groupBy("current", "change_set").agg(F.count(F.lit(1)).alias("shared"), F.count_if(inside).alias("within"))
    tops = h.where(inside).groupBy("change_set", top_of).agg(F.count(F.lit(1)).alias("files"))
    close = tops.join(cur.where(inside).select("current", top_of).distinct(), "d").where("change_set != current").groupBy("current", "change_set").agg(F.sum("files").alias("close"))
    z = lambda x: F.coalesce(x, F.lit(0))
    n = close.join(exact, ["current", "change_set"], "full_outer").select("current", "change_set", z("shared").alias("shared"), (z("close") - z("within")).alias("near"))
    s = (F.col("shared") + 0.3 * F.col("near")) / (F.col("hn") + F.col("cn") - F.col("shared"))
    scored = n.join(hn, "change_set").join(cn.withColumnRenamed("change_set", "current"), "current").where(s >= least).select("current", "change_set", "shared", "near", round_half_up(s, 2).alias("similarity"))
    w = Window.partitionBy("current").orderBy(F.desc("similarity"), F.desc("shared"), "change_set")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct by keys, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__hd_n", F.row_number().over(w)).where("__hd_n = 1").drop("__hd_n")


def best_confidence(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct by keys, the highest confidence; the first in the given order among equals."""
    rest = [c for c in findings.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), *[-F.col(c) for c in order])).alias("x")
    return findings.groupBy(*keys).agg(best).select(*keys, "x.*")


def merge_duplicates(findings: DataFrame) -> DataFrame:
    """Findings alike in file, line, category and message hash become one: gravest severity, highest confidence."""
    return (
        findings.withColumn("message_hash", fnv1a32(F.col("message")))
        .groupBy("file", "line", "category", "message_hash")
        .agg(F.max_by("severity", ordinal(F.col("severity"))).alias("severity"), F.max("confidence").alias("confidence"), F.max_by("message", F.length("message")).alias("message"), F.count(F.lit(1)).alias("merged"))
    )


def fold_nearby(findings: DataFrame, reach: int = 5, alike: float = 0.56) -> DataFrame:
    """In each (file, category), in order of line, a finding joins the last kept one within reach whose message is alike.

    The kept row holds its first line, the gravest severity, the highest confidence and the longest message. An
    ordered fold over the group's rows as one expression; groups are the findings of one file and category.
    """
    row = F.struct(F.col("line"), F.col("message"), ordinal(F.col("severity")).alias("sev"), F.col("confidence"))
    groups = findings.groupBy("file", "category").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        joins = last.isNotNull() & (F.abs(x["line"] - last["line"]) <= reach) & (similarity(last["message"], x["message"]) >= alike)
        merged = F.struct(
            last["line"].alias("line"),
            F.when(F.length(x["message"]) > F.length(last["message"]), x["message"]).otherwise(last["message"]).alias("message"),
            F.greatest(last["sev"], x["sev"]).alias("sev"),
            F.greatest(last["confidence"], x["confidence"]).alias("confidence"),
            (last["merged"] + 1).alias("merged"),
        )
        new = F.struct(x["line"].alias("line"), x["message"].alias("message"), x["sev"].alias("sev"), x["confidence"].alias("confidence"), F.lit(1).alias("merged"))
        done = F.when(joins | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(joins, merged).otherwise(new).alias("last"))

    kind = findings.select("line", "message", ordinal(F.col("severity")).alias("sev"), "confidence").schema
    item = "struct<line:{},message:string,sev:int,confidence:{},merged:int>".format(*(kind[c].dataType.simpleString() for c in ("line", "confidence")))
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("last"))
    folded = groups.select("file", "category", F.explode(F.aggregate("rows", start, step, lambda acc: F.concat(acc["done"], F.array(acc["last"])))).alias("x"))
    return folded.select("file", "category", "x.*")


def fuzzy_pairs(names: DataFrame, block: Column, at: float = 0.7) -> DataFrame:
    """names: name. Pairs within a block whose normalised similarity reaches `at`, each once, the smaller name first."""
    b = names.select("name", block.alias("__hd_b")).distinct()
    a, c = b.alias("a"), b.alias("c")
    return a.join(c, (F.col("a.__hd_b") == F.col("c.__hd_b")) & (F.col("a.name") < F.col("c.name")) & (similarity(F.col("a.name"), F.col("c.name")) >= at)).select(F.col("a.name").alias("a"), F.col("c.name").alias("b"))


def within_edits(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """left, right: name. Different names within so many edits; exact.

    Of edits + 1 pieces of a name one stays whole, and in the other name it lies at most `edits` places off. Names meet
    by (length of the left name, number of the piece, piece), then levenshtein decides.
    """
    k, n = edits, F.length("name")
    names = lambda df, c: df.select("name").where("name is not null").distinct().select("name", c)
    cut = lambda size, i: F.floor(size * i / (k + 1)).cast("int")

    def key(size: Column, i: int, off: int) -> Column:
        start, long = cut(size, i) + off, cut(size, i + 1) - cut(size, i)
        inside = (size >= 0) & (start >= 0) & (start + long <= n)
        return F.when(inside, F.struct(size.alias("size"), F.lit(i).alias("i"), F.substr("name", start + 1, long).alias("piece")))

    mine = F.array(*[key(n, i, 0) for i in range(k + 1)])
    theirs = F.array_distinct(F.array_compact(F.array(*[key(n + d, i, off) for d in range(-k, k + 1) for i in range(k + 1) for off in range(-k, k + 1)])))
    l = names(left, F.explode(mine).alias("k")).withColumnRenamed("name", "a")
    r = names(right, F.explode(theirs).alias("k")).withColumnRenamed("name", "b")
    return l.join(r, "k").where("a != b").select("a", "b").distinct().where(F.levenshtein("a", "b", edits) >= 0)


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs (old, new) of names in one file that look like a rename."""
    a, b = removed.select("file", F.col("name").alias("old")), added.select("file", F.col("name").alias("new"))
    return a.join(b, "file").where((F.col("old") != F.col("new")) & likely_rename(F.col("old"), F.col("new")))


def recurrence(patterns: DataFrame, as_of: str, days: int = 30, least: int = 3, latest: int = 5, per_key: int | None = None) -> DataFrame:
    """patterns: key, change_set, at. Keys seen in enough change sets within the interval, with the latest sets.

    With per_key only so many newest rows of a key count, as in a log with that capacity.
    """
    live = patterns.where(F.col("at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    if per_key is not None:
        w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("change_set"))
        live = live.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_key)
    per = live.groupBy("key", "change_set").agg(F.max("at").alias("at"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("at", "change_set")), asc=False), 1, latest)
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.concat_ws(",", F.transform(top, lambda x: x["change_set"].cast("string"))).alias("latest")).where(F.col("sets") >= least)


def replies(turns: DataFrame) -> DataFrame:
    """turns: thread, pos, author, text. Each root (position 0) with later rows by its author, counted, and the last one's kind."""
    root = turns.where("pos = 0").select("thread", "author")
    later = turns.where("pos > 0").join(root, ["thread", "author"]).groupBy("thread").agg(F.count(F.lit(1)).alias("replies"), F.max_by("text", "pos").alias("last"))
    return root.join(later, "thread", "left").select("thread", "author", F.coalesce("replies", F.lit(0)).alias("replies"), dismissal(F.col("last")).alias("kind"))


# The kinds of dismissal and the words that tell them, the first that fits counting.
DISMISSALS = (
    ("intentional", r"\b(intentional|by design|on purpose|expected behavior|working as intended)\b"),
    ("will-fix-later", r"\b(will fix|follow.?up|later|next pr|tracked in|JIRA|ticket|issue #)\b"),
    ("disagree", r"\b(disagree|not applicable|doesn't apply|not relevant|not needed|unnecessary)\b"),
    ("already-known", r"\b(known issue|legacy|existing|already known|historical)\b"),
    ("false-positive", r"\b(false positive|won't fix|not a bug|not an issue|n/a)\b"),
)


def dismissal(text: Column) -> Column:
    """Why a remark is dismissed; null where it is not."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + pattern), name) for name, pattern in DISMISSALS])


def suppress(findings: DataFrame, memories: DataFrame) -> DataFrame:
    """memories: id, repo, category, file_pattern, message_pattern. Adds the id of the first memory that covers a finding.

    Joined on repo and category; the glob must fit the file, and a message pattern of five characters or more must be
    contained in the message, shorter ones are not looked at.
    """
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("m.file_pattern", r"([.+^${}()|\[\]\\?])", r"\\$1"), r"\*", "[^/]*"), F.lit("$"))
    text = F.coalesce(F.col("m.message_pattern"), F.lit(""))
    on = (F.col("f.repo") == F.col("m.repo")) & (F.col("f.category") == F.col("m.category")) & F.rlike(F.col("f.file"), glob) & ((F.length(text) < 5) | F.col("f.message").contains(text))
    keyed = findings.withColumn("__hd_k", F.xxhash64(F.struct(*findings.columns)))
    hit = keyed.alias("f").join(memories.alias("m"), on).groupBy("f.__hd_k").agg(F.min("m.id").alias("suppressed_by"))
    return keyed.join(hit, "__hd_k", "left").drop("__hd_k")

"""What a change set is and how much work it asks for: kind, tier, effort, description quality, chunks, run costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.globs import matches_any
from heddle.functions.severity import lookup

# What a path says about its file; whole path parts and endings, so that `author.ts` is no login code.
DOCS = r"(?i)\.(markdown|md|mdx|rst|adoc|txt|tex)$|(^|/)(documentation|docs?|man)/|(^|/)(changelog|contributing|history|license|notice|readme)[^/]*$"
TEST = r"(?i)(^|/)(__tests__|e2e|spec|specs|test|tests)/|[._-](spec|test)\.[a-z]+$|(^|/)test_[^/]*$"
CONFIG = r"(?i)\.(cfg|conf|env|ini|json5?|properties|toml|ya?ml)$|(^|/)\.[a-z]+rc$|(^|/)(\.circleci|\.github|config|settings)/"
SECURITY = r"(?i)(^|[/._-])(acl|auth[nz]?|authentication|authorization|cipher|credentials?|csrf|crypto|iam|jwt|login|oauth2?|passwords?|permissions?|rbac|secrets?|session|sql|sso|tokens?)([/._-]|$)"
COSMETIC = r"(?i)\.(bmp|css|gif|html?|ico|jpe?g|less|otf|png|s[ac]ss|svg|ttf|webp|woff2?)$"
# What a description tells, by words of its text in lower case.
REASON = r"\b(because|background|caused? by|context|in order to|intended to|needed (for|to)|otherwise|problem|rationale|so that|therefore|to avoid)\b"
TRIED = r"\b(checked (by|with)|how to (check|reproduce|test)|qa|reproduc\w+|test (cases?|evidence|plan|run)|tested (by|on|with)|tests? (pass|added)|verif\w+)\b"
CAREFUL = r"\b(back(wards?)?[- ]compatib\w+|breaks?|breaking|deprecat\w+|migrat\w+|no longer|old clients?|removed? support|roll ?back|upgrad\w+)\b"
LINKED = r"(^|[\s(])(#|gh-|[a-z][a-z0-9]+-)\d+\b"
# Price of a thousand tokens in and out, by provider.
PRICE_IN, PRICE_OUT = {"anthropic": 0.003, "openai": 0.002}, {"anthropic": 0.015, "openai": 0.008}
PRICE_IN_ELSE, PRICE_OUT_ELSE = 0.001, 0.003


def classify(files: DataFrame) -> DataFrame:
    """files: change_set, path, additions, deletions. The first kind that fits: docs, tests, config, security, cosmetic, logic."""
    p = F.col("path")
    every = lambda rx: F.bool_and(p.rlike(rx))
    plus, minus = F.sum("additions"), F.sum("deletions")
    kind = (
        F.when(every(DOCS), "docs")
        .when(every(TEST) & F.bool_and(F.col("deletions") == 0), "tests")
        .when(every(CONFIG), "config")
        .when(F.bool_or(p.rlike(SECURITY)), "security")
        .when(every(COSMETIC) & (minus > 0) & (plus > 5 * minus), "cosmetic")
        .otherwise("logic")
    )
    return files.groupBy("change_set").agg(kind.alias("kind"))


def tier(files: DataFrame, security_globs: list[str], light_below: int = 50) -> DataFrame:
    """thorough where a security glob fits, light for few lines in fewer than three files, else standard."""
    t = F.when(F.bool_or(matches_any(F.col("path"), security_globs)), "thorough").when((F.sum(F.col("additions") + F.col("deletions")) < light_below) & (F.count(F.lit(1)) < 3), "light").otherwise("standard")
    return files.groupBy("change_set").agg(t.alias("tier"))


def effort(lines: Column, findings: Column) -> Column:
    """1 to 5: one more above 500 and 1500 lines, above 5 and 15 findings."""
    steps = [lines > 500, lines > 1500, findings > 5, findings > 15]
    return F.least(sum((s.cast("int") for s in steps), F.lit(1)), F.lit(5))


def description_quality(title: Column, body: Column) -> Column:
    """One point each for a reason (or a long body), a linked issue, a way to test and a word on compatibility.

    An empty body needs no word on compatibility, as nothing is claimed; without title and body there are no points.
    """
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    text = F.lower(F.concat_ws("\n", title, body))
    points = (text.rlike(REASON) | (F.length(body) > 100), text.rlike(LINKED), text.rlike(TRIED), text.rlike(CAREFUL) | (body == ""))
    total = F.lit(0)
    for p in points:
        total = total + p.cast("int")
    return F.when((title == "") & (body == ""), 0).otherwise(total)


def tag_provenance(content: Column, level: str, label: str) -> Column:
    return F.concat(F.lit(f"[provenance:{level}:{label}]\n"), content, F.lit(f"\n[/provenance:{level}:{label}]"))


def strip_provenance(content: Column) -> Column:
    return F.regexp_replace(content, r"\[/?provenance:\w+:[^\]]+\]\n?", "")


def call_cost(provider: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1000 * lookup(PRICE_IN, provider, PRICE_IN_ELSE) + tokens_out / 1000 * lookup(PRICE_OUT, provider, PRICE_OUT_ELSE)


def run_summary(stages: DataFrame, calls: DataFrame) -> DataFrame:
    """stages: run_id, status; calls: run_id, provider, input_tokens, output_tokens. Stages, failures, tokens and cost of each run."""
    s = stages.groupBy("run_id").agg(F.count(F.lit(1)).alias("stages"), F.count_if(F.col("status") == "failed").alias("failed"))
    c = calls.groupBy("run_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum(call_cost(F.col("provider"), F.col("input_tokens"), F.col("output_tokens"))).alias("cost"))
    return s.join(c, "run_id", "full_outer")


def chunks(files: DataFrame, single: int = 10, medium: int = 25, medium_chunks: int = 3, most: int = 5, least: int = 3) -> DataFrame:
    """files: change_set, path. Adds a chunk number to each file, chunks being sets of files to be read together.

    Up to `single` files are one chunk. Up to `medium` go by top directory, the largest groups opening the chunks and
    the others joining the one with fewest files. More go by the first two directories; groups under `least` files
    join the one before, and chunks at the end are folded until `most` are left. One change set is one group.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = sorted(pdf["path"])
        depth = 1 if len(paths) <= medium else 2
        groups: dict[str, list[str]] = {}
        for p in paths:
            groups.setdefault("/".join(p.split("/")[:-1][:depth]), []).append(p)
        out: list[list[str]] = []
        if len(paths) <= single:
            out = [paths]
        elif len(paths) <= medium:
            for g in sorted(groups.values(), key=lambda g: (-len(g), g[0])):
                if len(out) < medium_chunks:
                    out.append(list(g))
                else:
                    min(out, key=len).extend(g)
        else:
            for g in sorted(groups.values(), key=lambda g: (-len(g), g[0])):
                if len(g) < least and out:
                    out[-1].extend(g)
                else:
                    out.append(list(g))
            while len(out) > most:
                last = out.pop()
                out[-1].extend(last)
        rows = [(pdf["change_set"].iloc[0], p, i) for i, c in enumerate(out) for p in c]
        return pd.DataFrame(rows, columns=["change_set", "path", "chunk"])

    kind = files.schema["change_set"].dataType.simpleString()
    return files.select("change_set", "path").distinct().groupBy("change_set").applyInPandas(pack, f"change_set {kind}, path string, chunk int")


def split_suggestions(files: DataFrame, foundation: str = r"(?i)(^|/)(types?|config|schema|shared|common|lib)/", most: int = 4) -> DataFrame:
    """files: change_set, path. Parts into which a change set could be split: change_set, part (from 0), area, files.

    Files that others build on come first; then the areas (top two directories) by size. Areas beyond `most` parts are
    folded into the last. Change sets of one part are left out.
    """
    area = F.when(F.col("path").rlike(foundation), "foundation").otherwise(F.regexp_extract("path", r"^([^/]*/?[^/]*)/[^/]*$", 1))
    n = files.select("change_set", "path").distinct().groupBy("change_set", area.alias("area")).agg(F.count(F.lit(1)).alias("files"))
    w = Window.partitionBy("change_set").orderBy((F.col("area") != "foundation").cast("int"), F.desc("files"), "area")
    ranked = n.select("change_set", "area", "files", F.least(F.row_number().over(w) - 1, F.lit(most - 1)).alias("part"))
    parts = ranked.groupBy("change_set", "part").agg(F.array_join(F.array_sort(F.collect_list("area")), "+").alias("area"), F.sum("files").alias("files"))
    several = parts.groupBy("change_set").count().where("count > 1").select("change_set")
    return parts.join(several, "change_set", "left_semi")


def mine_skills(notes: DataFrame, least: int = 3) -> DataFrame:
    """notes: text of remembered findings, `- [category] path: ...` a line. Pairs of category and path told often enough."""
    line = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^- (\[\w+\] [^:\n]+):"), F.lit(1))).alias("x")
    pair = notes.select(line).select(F.regexp_extract("x", r"^\[(\w+)\]", 1).alias("category"), F.regexp_extract("x", r"\] (.+)$", 1).alias("path"))
    return pair.groupBy("category", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def consolidate(entries: DataFrame, capacity: int = 2048, fill: float = 0.8) -> DataFrame:
    """entries: repo, pos, text. The newest distinct entries of each repo that fit: once all exceed `fill` of the capacity
    (in characters, a line end for each), older ones go until that share is kept; a repeated text counts at its newest place."""
    size = F.length("text") + 1
    last = entries.groupBy("repo", "text").agg(F.max("pos").alias("pos"))
    w = Window.partitionBy("repo").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= int(capacity * fill)).drop("used")

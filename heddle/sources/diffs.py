"""Unified diffs as relations: files, hunks and numbered lines, by running sums over a patch's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.globs import matches_any


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """change_set (the file's name) and patch of each file under path."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.\w+)?$", 1).alias("change_set"), F.col("value").alias("patch"))


def parse_diff(patches: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """patches: change_set, patch. Returns change_set, path, status, hunk, op, pos, line, old_line, content.

    Handles `diff --git` patches and bare `---`/`+++` ones (as some platforms give them). status is added, deleted,
    renamed or modified, in that order of precedence. Numbering follows the hunk headers. Files that an exclude glob
    fits are dropped before their lines are numbered. An empty patch gives no rows.
    """
    w = Window.partitionBy("change_set").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    t = patches.select("change_set", F.posexplode(F.split(F.coalesce("patch", F.lit("")), "\r?\n")).alias("n", "t"))
    git = F.col("t").startswith("diff --git ")
    bare = F.col("t").startswith("--- ") & F.lead("t").over(w).startswith("+++ ")
    has_git = F.max(F.col("t").startswith("diff --git ")).over(Window.partitionBy("change_set"))
    t = t.withColumn("f", F.sum(F.when(has_git, git).otherwise(bare).cast("int")).over(so_far)).where("f > 0")
    in_file = Window.partitionBy("change_set", "f").orderBy("n")
    up_to = in_file.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("change_set", "f")
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    hunk = F.col("t").rlike(head)
    t = t.withColumn("hunk", F.sum(hunk.cast("int")).over(up_to))
    meta = F.col("hunk") == 0
    new_name = F.max(F.when(meta & F.col("t").startswith("+++ "), F.regexp_extract("t", r"^\+\+\+ (?:b/)?([^\t]*)", 1))).over(whole)
    old_name = F.max(F.when(meta & F.col("t").startswith("--- "), F.regexp_extract("t", r"^--- (?:a/)?([^\t]*)", 1))).over(whole)
    named = F.max(F.when(F.col("t").startswith("diff --git "), F.regexp_extract("t", r"^diff --git a/.* b/(.*)$", 1))).over(whole)
    flag = lambda p: F.max(meta & F.col("t").rlike(p)).over(whole)
    status = (
        F.when(flag("^new file mode") | (old_name == "/dev/null"), "added").when(flag("^deleted file mode") | (new_name == "/dev/null"), "deleted").when(flag("^rename (from|to) "), "renamed").otherwise("modified")
    )
    path = F.when(new_name.isNull() | (new_name == "/dev/null"), F.coalesce(named, old_name)).otherwise(new_name)
    t = t.withColumns({"path": path, "status": status})
    if exclude:
        t = t.where(~matches_any(F.col("path"), exclude))
    t = t.where((F.col("hunk") > 0) & (hunk | F.col("t").rlike(r"^[-+ ]")))
    in_hunk = Window.partitionBy("change_set", "f", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.substring("t", 1, 1)
    count = lambda marks: F.sum((~hunk & sign.isin(*marks)).cast("int")).over(in_hunk)
    start = lambda i: F.first(F.regexp_extract("t", head, i).cast("string")).over(in_hunk).cast("bigint")
    t = t.withColumns({"is_head": hunk, "line": start(2) + count("+ ") - 1, "old_line": start(1) + count("- ") - 1}).where("not is_head")
    op = F.when(sign == "+", "add").when(sign == "-", "delete").otherwise("normal")
    return t.select(
        "change_set", "path", "status", "hunk", op.alias("op"), F.row_number().over(in_file).cast("bigint").alias("pos"), F.when(op != "delete", F.col("line")).alias("line"), F.when(op != "add", F.col("old_line")).alias("old_line"), F.substr("t", F.lit(2)).alias("content")
    )


def files(lines: DataFrame) -> DataFrame:
    return lines.groupBy("change_set", "path", "status").agg(F.count_if(F.col("op") == "add").alias("additions"), F.count_if(F.col("op") == "delete").alias("deletions"), F.max("hunk").alias("hunks"))


def totals(lines: DataFrame) -> DataFrame:
    f = files(lines)
    return f.groupBy("change_set").agg(F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def valid_lines(lines: DataFrame) -> DataFrame:
    """Lines of the new side that a remark may stand on."""
    return lines.where("op != 'delete'").select("change_set", F.col("path").alias("file"), "line").distinct()


def import_edges(lines: DataFrame) -> DataFrame:
    """Edges source, target, kind, line from added import lines; each of five patterns may give one; no self edges."""
    from heddle.functions.text import directory, resolve_relative, strip_extension

    patterns = {
        "import": r"^\s*import\s+.*from\s+['\"](\.[^'\"]+)['\"]",
        "side-effect": r"^\s*import\s+['\"](\.[^'\"]+)['\"]",
        "require": r"require\(\s*['\"](\.[^'\"]+)['\"]",
        "re-export": r"^\s*export\s+.*from\s+['\"](\.[^'\"]+)['\"]",
        "dynamic-import": r"import\(\s*['\"](\.[^'\"]+)['\"]",
    }
    c = F.col("content")
    hits = F.array(*[F.when(c.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(c, p, 1).alias("to"))) for k, p in patterns.items()])
    e = lines.where("op = 'add'").select("change_set", "path", "line", F.explode(F.array_compact(hits)).alias("x"))
    source, target = strip_extension(F.col("path")), strip_extension(resolve_relative(directory(F.col("path")), F.col("x.to")))
    return e.select("change_set", source.alias("source"), target.alias("target"), "x.kind", "line").where("source != target").distinct()

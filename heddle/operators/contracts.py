"""Detectors that relate declarations, uses and blocks of different lines or files.

lines: change_set, path, status, op, pos, line, content, as in `detectors`. What is found has change_set, path, line, kind
and mostly `symbol`. Symbols are extracted once by regular expressions and met by equi-joins; blocks are ranges of a file
found by running brace depths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import directory, likely_rename, resolve_relative, strip_extension
from heddle.operators.detectors import KEYS, TESTS

# Patterns of this library's own, which the statements share.
IMPORT = r"^\s*import\s+\{([^}]*)\}\s+from\s+['\"](\.[^'\"]+)['\"]"
EXPORT = r"^\s*export\s+(?:async\s+)?(?:function|class|const|interface|type|enum)\s+(\w+)"
FUNCTION = r"\bfunction\s+(\w+)\(([^)]*)\)"
THROWN = r"\bthrow\s+new\s+(\w+)"
CALL = r"(\w+)\("
TEST_START = r"\b(?:it|test)\(['\"]"
ASYNC_START = r"\basync\s+function\s+\w+\("
CLASS_START = r"^\s*(?:export\s+)?class\s+(\w+)"
ASSERTION = r"\bexpect\(|\bassert\w*\("
MODULE_VARIABLE = r"^(?:let|var)\s+(\w+)\s*="
TRANSITION = r"\btarget:\s*'(\w+)'"
STATE = r"^\s*state\s+(\w+)\s*\{"
SET_STATE = r"\bsetState\('(\w+)'\)"
EXEMPT_STATES = ("idle", "initial", "start", "error", "failed")
PACKAGE = r"from\s+['\"](@[\w-]+/[\w.-]+|[a-z][\w.-]*)"
DEPENDENCY = r"^\s*\"([@\w/.-]+)\":\s*\"[\^~]?\d"
LOCK_VERSION = r"\"lockfileVersion\":\s*(\d+)"
CONSTANT = r"\bconst\s+\w+\s*=\s*['\"]([^'\"]{4,})['\"]"
DECLARED = r"\b(?:function|const)\s+([a-z]+)([A-Z]\w*)"
INTERFACE = r"\binterface\s+(\w+)"
IMPLEMENTS = r"\bimplements\s+(\w+)"
EXTENDS = r"\bclass\s+(\w+)\s+extends\s+(\w+)"
DECORATOR = r"^\s*@\w+"
#: Words that mean the same; each group's first stands for it.
SYNONYMS = (("get", "fetch", "load", "read"), ("make", "build", "create"), ("remove", "delete", "drop"), ("check", "validate", "verify"), ("show", "render", "display"))
#: Call -> fewest and most arguments.
ARITY = {"parseInt": (1, 2), "setTimeout": (1, 9), "Math.max": (1, 9), "JSON.parse": (1, 2), "Object.assign": (2, 9), "Number": (1, 1)}
#: Module -> names that it does not export.
WRONG_EXPORTS = {"react": ("useFetch", "createState"), "fs": ("readJson", "exists2"), "express": ("createServer",)}


def _added(lines: DataFrame) -> DataFrame:
    return lines.where("op = 'add'")


def _symbol(lines: DataFrame, pattern: str, group: int = 1, *more: str) -> DataFrame:
    """Lines on which the pattern occurs, with the group as `symbol`."""
    return lines.where(F.col("content").rlike(pattern)).select(*KEYS, "pos", "line", F.regexp_extract("content", pattern, group).alias("symbol"), *more)


def _named(kind: str) -> Column:
    return F.lit(kind).alias("kind")


def _stem(path: Column) -> Column:
    return strip_extension(path)


def imported_names(lines: DataFrame) -> DataFrame:
    """change_set, path, line, target (a path without ending), symbol: a row for each name of an added relative import."""
    i = _added(lines).where(F.col("content").rlike(IMPORT))
    target = _stem(resolve_relative(directory(F.col("path")), F.regexp_extract("content", IMPORT, 2)))
    names = F.transform(F.split(F.regexp_extract("content", IMPORT, 1), ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+\w+$", ""))
    return i.select(*KEYS, "line", target.alias("target"), F.explode(names).alias("symbol")).where("symbol != ''").distinct()


def exported_names(lines: DataFrame) -> DataFrame:
    return _symbol(lines.where("op != 'delete' and status != 'deleted'"), EXPORT).select(_stem(F.col("path")).alias("target"), "symbol").distinct()


def missing_exports(lines: DataFrame) -> DataFrame:
    """Imported names that the file they come from does not export; files that are not here are not judged."""
    here = lines.where("status != 'deleted'").select(_stem(F.col("path")).alias("target")).distinct()
    return imported_names(lines).join(here, "target", "left_semi").join(exported_names(lines), ["target", "symbol"], "left_anti").select(*KEYS, "line", "symbol", _named("missing-export"))


def signatures(lines: DataFrame) -> DataFrame:
    """change_set, path, line, op, symbol, params, optional: functions as they stand on changed lines."""
    f = lines.where(F.col("op").isin("add", "delete") & F.col("content").rlike(FUNCTION))
    params = F.filter(F.transform(F.split(F.regexp_extract("content", FUNCTION, 2), ","), F.trim), lambda x: x != "")
    return f.select(*KEYS, "pos", "line", "op", F.regexp_extract("content", FUNCTION, 1).alias("symbol"), F.size(params).alias("params"), F.size(F.filter(params, lambda x: x.contains("=") | x.contains("?"))).alias("optional"))


def _both_sides(lines: DataFrame) -> DataFrame:
    """Functions of one file on both sides: the least place and the parameters of each."""
    s = signatures(lines)
    side = lambda op, p: s.where(F.col("op") == op).groupBy(*KEYS, "symbol").agg(F.min("line").alias(f"{p}_line"), F.max("params").alias(f"{p}_params"), F.max("optional").alias(f"{p}_optional"))
    return side("delete", "old").join(side("add", "new"), [*KEYS, "symbol"])


def new_required_parameters(lines: DataFrame) -> DataFrame:
    """Functions that take more than before; info where what is new has a default."""
    b = _both_sides(lines).where("new_params > old_params")
    optional = F.col("new_optional") - F.col("old_optional") >= F.col("new_params") - F.col("old_params")
    return b.select(*KEYS, F.col("new_line").alias("line"), "symbol", F.when(optional, "info").otherwise("critical").alias("severity"), _named("new-required-param"))


def calls(lines: DataFrame) -> DataFrame:
    """change_set, path, line, symbol of calls on added lines, declarations left out."""
    a = _added(lines).where(~F.col("content").rlike(FUNCTION))
    return a.select(*KEYS, "line", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)))).alias("symbol"))


def narrowed_signature_calls(lines: DataFrame) -> DataFrame:
    """Calls, in other files, of functions that take fewer parameters than before."""
    less = _both_sides(lines).where("new_params < old_params").select("change_set", F.col("path").alias("declared"), "symbol")
    return calls(lines).join(less, ["change_set", "symbol"]).where("path != declared").select(*KEYS, "line", "symbol", _named("signature-change")).distinct()


def unhandled_throws(lines: DataFrame, reach: int = 30) -> DataFrame:
    """Calls of functions of the change set that throw, with no `try` in the lines before or no `catch` from there on, within reach."""
    inside = _inside(lines, FUNCTION)
    starts = _added(lines).select(*KEYS, "line", F.regexp_extract("content", FUNCTION, 1).alias("symbol"))
    throwers = inside.where(F.col("content").rlike(THROWN)).select(*KEYS, "line").distinct().join(starts, [*KEYS, "line"]).select("change_set", "symbol").distinct()
    w = Window.partitionBy(*KEYS).orderBy("pos")
    near = lambda rx, a, b: F.max(F.col("content").rlike(rx).cast("int")).over(w.rowsBetween(a, b))
    safe = _added(lines).select(*KEYS, "line", (near(r"\btry\b", -reach, 0) + near(r"\bcatch\b", 0, reach) == 2).alias("safe"))
    return calls(lines).join(throwers, ["change_set", "symbol"]).join(safe.where("not safe"), [*KEYS, "line"]).select(*KEYS, "line", "symbol", _named("unhandled-throw"))


def new_thrown_types(lines: DataFrame) -> DataFrame:
    """Types that a file throws on added lines and not on removed ones, at their first line."""
    gone = _symbol(lines.where("op = 'delete'"), THROWN).select(*KEYS, "symbol").distinct()
    return _symbol(_added(lines), THROWN).groupBy(*KEYS, "symbol").agg(F.min("line").alias("line")).join(gone, [*KEYS, "symbol"], "left_anti").select(*KEYS, "line", "symbol", _named("changed-thrown-exceptions"))


def renamed_exports(lines: DataFrame) -> DataFrame:
    """Removed and added exports of one file that look like one name changed."""
    old = _symbol(lines.where("op = 'delete'"), EXPORT).select(*KEYS, F.col("symbol").alias("old")).distinct()
    new = _symbol(_added(lines), EXPORT).groupBy(*KEYS, F.col("symbol").alias("new")).agg(F.min("line").alias("line"))
    j = old.join(new, list(KEYS)).where((F.col("old") != F.col("new")) & likely_rename(F.col("old"), F.col("new")))
    return j.select(*KEYS, "line", F.concat("old", F.lit(" -> "), "new").alias("symbol"), _named("renamed-export"))


def blocks(lines: DataFrame, start: str) -> DataFrame:
    """change_set, path, line, start, end: from each added line that opens a block to the line on which its brace closes.

    A block that does not close goes to the file's end; a start without an open brace is a block of its line.
    """
    w = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("content")
    n = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    d = _added(lines).select(*KEYS, "pos", "line", "content", F.sum(n("{") - n("}")).over(w).alias("depth"), (n("{") - n("}")).alias("step"))
    s = d.where(F.col("content").rlike(start)).select(*KEYS, F.col("line").alias("at"), F.col("pos").alias("start"), (F.col("depth") - F.col("step")).alias("base"), "step")
    ends = s.join(d.select(*KEYS, "pos", "depth"), list(KEYS)).groupBy(*KEYS, "at", "start", "step").agg(F.min(F.when((F.col("pos") >= F.col("start")) & (F.col("depth") <= F.col("base")), F.col("pos"))).alias("closed"), F.max("pos").alias("last"))
    return ends.select(*KEYS, F.col("at").alias("line"), "start", F.when(F.col("step") <= 0, F.col("start")).otherwise(F.coalesce("closed", "last")).alias("end"))


def _inside(lines: DataFrame, start: str) -> DataFrame:
    b = blocks(lines, start)
    inner = _added(lines).select(*KEYS, "pos", F.col("line").alias("inner"), "content")
    return b.join(inner, list(KEYS)).where("pos between start and end")


def assertion_free_tests(lines: DataFrame) -> DataFrame:
    """Test blocks that assert nothing."""
    t = _inside(lines, TEST_START).groupBy(*KEYS, "line").agg(F.bool_or(F.col("content").rlike(ASSERTION)).alias("asserts"))
    return t.where("not asserts").select(*KEYS, "line", _named("assertion-free-test"))


def returns_without_await(lines: DataFrame) -> DataFrame:
    """Returned calls of async functions that are not awaited."""
    r = _inside(lines, ASYNC_START).where(F.col("content").rlike(r"^\s*return\s+\w[\w.]*\(") & ~F.col("content").rlike(r"\bawait\b"))
    return r.select(*KEYS, F.col("inner").alias("line"), _named("spec-implementation-mismatch")).distinct()


def shared_mutable_state(lines: DataFrame) -> DataFrame:
    """Module variables assigned inside an async function on another line."""
    m = _symbol(_added(lines), MODULE_VARIABLE).select(*KEYS, "symbol", F.col("line").alias("declared"))
    a = _inside(lines, ASYNC_START).select(*KEYS, F.col("inner").alias("line"), F.regexp_extract("content", r"^\s*(\w+)\s*(?:=[^=]|\+=|-=|\+\+)", 1).alias("symbol")).where("symbol != ''")
    return a.join(m, [*KEYS, "symbol"]).where("line != declared").select(*KEYS, "line", "symbol", _named("shared-mutable-state")).distinct()


def facades(lines: DataFrame) -> DataFrame:
    """Classes of two or three methods of which all but one at most hand on, and classes with a private constructor and an instance accessor."""
    method, hands = r"^\s*(?:async\s+)?\w+\([^)]*\)\s*\{", r"return\s+this\.\w+\.\w+\("
    c = _inside(lines, CLASS_START).groupBy(*KEYS, "line").agg(
        F.count_if(F.col("content").rlike(method)).alias("methods"), F.count_if(F.col("content").rlike(hands)).alias("handed"), F.bool_or(F.col("content").rlike(r"private\s+constructor")).alias("hidden"), F.bool_or(F.col("content").rlike(r"getInstance\(")).alias("one")
    )
    kinds = F.array_compact(F.array(F.when(F.col("methods").between(2, 3) & (F.col("handed") >= F.col("methods") - 1), "enterprise-facade"), F.when(F.col("hidden") & F.col("one"), "singleton-misuse")))
    return c.select(*KEYS, "line", F.explode(kinds).alias("kind"))


def state_machines(lines: DataFrame) -> DataFrame:
    """States set that no transition of the file leads to, and states defined that none leads to; files without transitions are left out."""
    a = _added(lines)
    targets = _symbol(a, TRANSITION).select(*KEYS, "symbol").distinct()
    some = targets.select(*KEYS).distinct()
    odd = lambda df, kind: df.where(~F.col("symbol").isin(*EXEMPT_STATES)).join(some, list(KEYS), "left_semi").join(targets, [*KEYS, "symbol"], "left_anti").select(*KEYS, "line", "symbol", _named(kind))
    return odd(_symbol(a, SET_STATE), "invalid-transition").unionByName(odd(_symbol(a, STATE), "unreachable-state"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """The third blank added line in a row, once a file, and handlers that are empty on their line."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    blank = F.col("content").rlike(r"^\s*$")
    a = _added(lines).select(*KEYS, "pos", "line", "content", blank.alias("blank"), F.lag(blank, 1, False).over(w).alias("b1"), F.lag(blank, 2, False).over(w).alias("b2"))
    third = a.where("blank and b1 and b2").groupBy(*KEYS).agg(F.min("line").alias("line"))
    return third.unionByName(a.where(F.col("content").rlike(r"\b(try|catch)\s*(\(\w*\))?\s*\{\s*\}")).select(*KEYS, "line")).distinct().select(*KEYS, "line", _named("boilerplate-expansion"))


def unknown_imports(lines: DataFrame, known: DataFrame) -> DataFrame:
    """known: symbol (package names). Added imports of other packages; scoped ones are a kind of their own."""
    root = F.when(F.col("symbol").startswith("@"), F.col("symbol")).otherwise(F.split_part("symbol", F.lit("/"), F.lit(1)))
    p = _symbol(_added(lines), PACKAGE).withColumn("symbol", root)
    return p.join(known.select("symbol").distinct(), "symbol", "left_anti").select(*KEYS, "line", "symbol", F.when(F.col("symbol").startswith("@"), "phantom-scoped-import").otherwise("unknown-import").alias("kind"))


def dependencies(lines: DataFrame) -> DataFrame:
    """Packages added to a manifest that no file of the change set but its tests imports, and lock files of another version than 2 or 3."""
    new = _symbol(_added(lines).where(F.col("path").endswith("package.json")), DEPENDENCY)
    used = _symbol(_added(lines).where(~F.col("path").rlike(TESTS)), PACKAGE).select("change_set", "symbol").distinct()
    unused = new.join(used, ["change_set", "symbol"], "left_anti").select(*KEYS, "line", "symbol", _named("unused-new-dependency"))
    lock = _symbol(_added(lines), LOCK_VERSION).groupBy(*KEYS).agg(F.max_by(F.struct("line", "symbol"), "pos").alias("x")).select(*KEYS, "x.*")
    return unused.unionByName(lock.where(~F.col("symbol").isin("2", "3")).select(*KEYS, "line", "symbol", _named("lockfile-version-drift")))


def mirrored_constants(lines: DataFrame) -> DataFrame:
    """Constants of a test that a file under test of the change set holds too."""
    c = _symbol(_added(lines), CONSTANT)
    test = F.col("path").rlike(TESTS)
    return c.where(test).join(c.where(~test).select("change_set", "symbol").distinct(), ["change_set", "symbol"], "left_semi").select(*KEYS, "line", "symbol", _named("fixture-mirror-constant"))


def _canonical(verb: Column) -> Column:
    known = F.create_map(*[F.lit(x) for group in SYNONYMS for word in group for x in (word, group[0])])
    return F.coalesce(F.try_element_at(known, verb), verb)


def synonymous_names(lines: DataFrame) -> DataFrame:
    """Declarations that mean what another one of the change set means: same noun, a verb of the same meaning, another name and file."""
    d = _added(lines).where(F.col("content").rlike(DECLARED))
    d = d.select(*KEYS, "line", F.regexp_extract("content", DECLARED, 1).alias("verb"), F.regexp_extract("content", DECLARED, 2).alias("noun")).withColumn("means", _canonical(F.col("verb")))
    names = d.groupBy("change_set", "means", "noun").agg(F.count_distinct("verb").alias("verbs"), F.count_distinct("path").alias("files")).where("verbs > 1 and files > 1")
    twice = d.join(names, ["change_set", "means", "noun"]).select(*KEYS, "line", F.concat("verb", "noun").alias("symbol"), _named("duplicate-implementation"))
    styles = d.where(F.col("means").isin(*[g[0] for g in SYNONYMS])).groupBy("change_set", "means").agg(F.count_distinct("verb").alias("verbs"), F.count_distinct("path").alias("files"), F.min(F.struct("path", "line")).alias("at")).where("verbs > 1 and files > 1")
    return twice.unionByName(styles.select("change_set", F.col("at.path").alias("path"), F.col("at.line").alias("line"), F.col("means").alias("symbol"), _named("naming-inconsistency")))


def single_implementations(lines: DataFrame) -> DataFrame:
    """Interfaces that exactly one class of the change set implements."""
    one = _symbol(_added(lines), IMPLEMENTS).groupBy("change_set", "symbol").count().where("count = 1")
    return _symbol(_added(lines), INTERFACE).join(one, ["change_set", "symbol"], "left_semi").select(*KEYS, "line", "symbol", _named("interface-for-single-impl"))


def inheritance(lines: DataFrame) -> DataFrame:
    """node, parent of each class that extends another; the least parent where lines disagree."""
    e = _added(lines).where(F.col("content").rlike(EXTENDS))
    return e.groupBy(F.regexp_extract("content", EXTENDS, 1).alias("node")).agg(F.min(F.regexp_extract("content", EXTENDS, 2)).alias("parent")).where("node != parent")


def decorator_stacks(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of so many decorator lines, at their first."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    a = _added(lines).select(*KEYS, "pos", "line", "content", F.row_number().over(w).alias("n")).where(F.col("content").rlike(DECORATOR))
    runs = a.withColumn("run", F.col("n") - F.row_number().over(w)).groupBy(*KEYS, "run").agg(F.count(F.lit(1)).alias("size"), F.min("line").alias("line"))
    return runs.where(F.col("size") >= least).select(*KEYS, "line", "size", _named("decorator-stack"))


def wrong_calls(lines: DataFrame) -> DataFrame:
    """Calls with a number of plain arguments that the table doesn't allow, and imports of names that a module does not have."""
    hits = []
    for name, (few, most) in ARITY.items():
        pattern = r"(?:^|[^\w.])" + name.replace(".", r"\.") + r"\(([^()]*)\)"
        args = F.filter(F.split(F.regexp_extract("content", pattern, 1), ","), lambda x: F.trim(x) != "")
        hits.append(F.when(F.col("content").rlike(pattern) & ~F.size(args).between(few, most), F.struct(F.lit("wrong-arity").alias("kind"), F.lit(name).alias("symbol"))))
    for module, names in WRONG_EXPORTS.items():
        for name in names:
            hits.append(F.when(F.col("content").rlike(rf"import\s+\{{[^}}]*\b{name}\b[^}}]*\}}\s+from\s+['\"]{module}['\"]"), F.struct(F.lit("confabulated-import").alias("kind"), F.lit(name).alias("symbol"))))
    return _added(lines).select(*KEYS, "line", F.explode(F.array_compact(F.array(*hits))).alias("x")).select(*KEYS, "line", "x.symbol", "x.kind")


def orphaned_declarations(lines: DataFrame) -> DataFrame:
    """Exported names that no other line of the change set mentions."""
    d = _symbol(_added(lines).where(~F.col("content").rlike(r"\bexport\s+(?:default|type|interface)\b")), EXPORT)
    words = _added(lines).select("change_set", F.col("path").alias("p"), F.col("pos").alias("q"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("symbol"))
    elsewhere = (d["change_set"] == words["change_set"]) & (d["symbol"] == words["symbol"]) & ((d["path"] != words["p"]) | (d["pos"] != words["q"]))
    return d.join(words, elsewhere, "left_anti").select(*KEYS, "line", "symbol", _named("orphaned-spec"))


def symbol_impact(lines: DataFrame) -> DataFrame:
    """Exported names on changed lines with what imports them: weights 4 for handlers, 2 for callers, 1 for tests and types; critical from 7."""
    changed = _symbol(lines.where("op != 'normal'"), EXPORT).select(_stem(F.col("path")).alias("target"), "symbol").distinct()
    users = imported_names(lines).join(changed, ["target", "symbol"])
    weight = F.when(F.col("path").rlike(r"(?i)(^|/)(api|routes?|handlers?|lib)/"), 4).when(F.col("path").rlike(TESTS), 1).otherwise(2)
    score = users.select("target", "symbol", "path", weight.alias("w")).distinct().groupBy("target", "symbol").agg(F.count(F.lit(1)).alias("users"), F.sum("w").alias("score"))
    return score.select(F.col("target").alias("path"), "symbol", "users", "score", F.when(F.col("score") >= 7, "critical").otherwise("warning").alias("severity"))


def test_gaps(lines: DataFrame) -> DataFrame:
    """Files with new exports whose test is nowhere (no-test-file) or not in their change set (test-file-not-changed)."""
    new = _symbol(_added(lines).where(~F.col("path").rlike(TESTS)), EXPORT).groupBy("change_set", "path").agg(F.count_distinct("symbol").alias("symbols"))
    key = lambda p: F.regexp_extract(p, r"(\d+)\D*$", 1)  # noqa: E731  the number by which a file and its test belong together
    tests = lines.where(F.col("path").rlike(TESTS)).select("change_set", key(F.col("path")).alias("k")).distinct()
    mine = new.withColumn("k", key(F.col("path")))
    near = tests.select("change_set", F.col("k"), F.lit(True).alias("here"))
    any_ = tests.select("k").distinct().withColumn("any", F.lit(True))
    j = mine.join(near, ["change_set", "k"], "left").join(any_, "k", "left").where("here is null")
    return j.select("change_set", "path", "symbols", F.when(F.col("any"), "test-file-not-changed").otherwise("no-test-file").alias("kind"))


def forbidden_terms(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: number, term, path_pattern. Added lines that hold a word which an accepted decision forbids for their path."""
    words = _added(lines).select(*KEYS, "line", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"\w+"), F.lit(0)))).alias("term"))
    return words.join(decisions, "term").where(F.rlike("path", F.col("path_pattern"))).select(*KEYS, "line", F.col("term").alias("symbol"), F.concat(F.lit("ADR-"), "number").alias("kind"))


#: Intents in the order that breaks ties, with what speaks for each.
INTENTS = ("security", "bugfix", "feature", "refactor", "test", "docs", "config")


def intents(lines: DataFrame) -> DataFrame:
    """change_set, path, intent: the intent of each file with the most points, the earlier of equal ones."""
    c, p = F.col("content"), F.col("path")
    add, gone = F.count_if(F.col("op") == "add"), F.count_if(F.col("op") == "delete")
    has = lambda rx: F.max(((F.col("op") == "add") & c.rlike(rx)).cast("int"))
    f = lines.groupBy(*KEYS).agg(F.min("status").alias("status"), add.alias("plus"), gone.alias("minus"), has(r"(?i)\b(password|token|encrypt|auth\w*|secret)\b").alias("safe"), has(r"(?i)\b(fix|bug|null check|edge case|FIXME)\b").alias("fix"), has(r"\bexport\b").alias("out"))
    on = lambda test: test.cast("int")
    points = {
        "security": 3 * F.col("safe") + 2 * on(p.rlike(r"(?i)auth|secret|\.env$")),
        "bugfix": 3 * F.col("fix") + on(F.col("status") == "modified"),
        "feature": 3 * on(F.col("status") == "added") + 2 * F.col("out"),
        "refactor": 3 * on((F.col("minus") > 0) & (F.col("plus") <= 3 * F.col("minus"))),
        "test": 5 * on(p.rlike(TESTS)),
        "docs": 5 * on(p.rlike(r"(?i)\.md$")),
        "config": 5 * on(p.rlike(r"(?i)\.(ya?ml|json|tf)$|config|Dockerfile$")),
    }
    best = F.greatest(*points.values())
    return f.select(*KEYS, F.coalesce(*[F.when(points[k] == best, k) for k in INTENTS]).alias("intent"))


def dominant_intent(files: DataFrame) -> DataFrame:
    """files: change_set, intent. The most frequent intent of each change set, the earlier of equal ones."""
    place = F.array_position(F.array(*map(F.lit, INTENTS)), F.col("intent"))
    n = files.groupBy("change_set", "intent").agg(F.count(F.lit(1)).alias("files"))
    return n.groupBy("change_set").agg(F.max_by(F.struct("intent", "files"), F.struct("files", -place)).alias("x")).select("change_set", "x.*")


def collisions(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both: change_set, path. Paths that two different change sets hold: mine, theirs, path."""
    a, b = mine.select(F.col("change_set").alias("mine"), "path").distinct(), theirs.select(F.col("change_set").alias("theirs"), "path").distinct()
    return a.join(b, "path").where("mine != theirs").select("mine", "theirs", "path")


def delete_uses(edges: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """mine, theirs: change_set, path, status. Edges from a path that one set keeps to a path that another deletes."""
    kept = mine.where("status != 'deleted'").select(F.col("change_set").alias("mine"), F.col("path").alias("source")).distinct()
    gone = theirs.where("status = 'deleted'").select(F.col("change_set").alias("theirs"), F.col("path").alias("target")).distinct()
    return edges.select("source", "target").distinct().join(kept, "source").join(gone, "target").where("mine != theirs").select("mine", "theirs", "source", "target")


def boundary_violations(edges: DataFrame, context) -> DataFrame:
    """Edges whose ends are in different contexts, both known."""
    return edges.select("source", "target", context(F.col("source")).alias("from_context"), context(F.col("target")).alias("to_context")).where("from_context != to_context")


def lock_orders(sequences: DataFrame) -> DataFrame:
    """sequences: owner, pos, lock. Pairs of owners that take two locks in opposite orders: first, second, lock_a, lock_b."""
    s = sequences.groupBy("owner", "lock").agg(F.min("pos").alias("pos"))
    pairs = s.alias("x").join(s.alias("y"), F.col("x.owner") == F.col("y.owner")).where("x.pos < y.pos").select(F.col("x.owner").alias("owner"), F.col("x.lock").alias("before"), F.col("y.lock").alias("after"))
    there, back = pairs.where("before < after"), pairs.where("before > after")
    j = there.alias("t").join(back.alias("b"), (F.col("t.before") == F.col("b.after")) & (F.col("t.after") == F.col("b.before")))
    return j.select(F.col("t.owner").alias("first"), F.col("b.owner").alias("second"), F.col("t.before").alias("lock_a"), F.col("t.after").alias("lock_b"))

from heddle.operators import detectors as dt
from heddle.sources import diffs, sinks, stores, texts

PATCH = """diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,4 +1,6 @@
 import { x } from './x';
-  @UseGuards()
+  console.log(password);
+  debugger;
+  const unused = 1;
   return x;
@@ -20,2 +22,4 @@
   try {
+  } catch (e) {
+  }
   end
diff --git a/.env b/.env
new file mode 100644
--- /dev/null
+++ b/.env
@@ -0,0 +1 @@
+KEY=1
diff --git a/old.py b/old.py
deleted file mode 100644
--- a/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
-debugger;
-x
diff --git a/n.md b/m.md
rename from n.md
rename to m.md
"""


def lines(spark, patch=PATCH, exclude=None):
    return diffs.parse_diff(spark.createDataFrame([("c1", patch), ("c2", ""), ("c3", None)], "change_set string, patch string"), exclude)


def test_diff_lines_are_numbered(spark):
    got = [tuple(r) for r in lines(spark).where("path = 'src/a.ts'").orderBy("pos").select("hunk", "op", "line", "old_line", "content").collect()]
    assert got[:6] == [
        (1, "normal", 1, 1, "import { x } from './x';"), (1, "delete", None, 2, "  @UseGuards()"), (1, "add", 2, None, "  console.log(password);"), (1, "add", 3, None, "  debugger;"),
        (1, "add", 4, None, "  const unused = 1;"), (1, "normal", 5, 3, "  return x;"),
    ]
    assert got[6:] == [(2, "normal", 22, 20, "  try {"), (2, "add", 23, None, "  } catch (e) {"), (2, "add", 24, None, "  }"), (2, "normal", 25, 21, "  end")]


def test_diff_files_and_exclusion(spark):
    f = {r["path"]: (r["status"], r["additions"], r["deletions"]) for r in diffs.files(lines(spark)).collect()}
    assert f == {"src/a.ts": ("modified", 5, 1), ".env": ("added", 1, 0), "old.py": ("deleted", 0, 2)}
    assert {r["path"] for r in lines(spark, exclude=["src/**"]).select("path").distinct().collect()} == {".env", "old.py"}
    assert diffs.valid_lines(lines(spark)).count() == 10
    bare = "--- a/x.py\n+++ b/x.py\n@@ -3 +3,2 @@\n ctx\n+new\n"
    assert [(r["path"], r["line"]) for r in lines(spark, bare).orderBy("pos").collect()] == [("x.py", 3), ("x.py", 4)]


def test_detectors(spark):
    got = {(r["path"], r["line"], r["kind"]): r["severity"] for r in dt.findings(lines(spark)).collect()}
    assert got["src/a.ts", 3, "debugger-statement"] == "critical" and got["src/a.ts", 2, "sensitive-data-in-log"] == "critical"
    assert got["src/a.ts", 4, "unused-variable"] == "warning" and got["src/a.ts", 23, "empty-catch"] == "critical"
    assert (".env", 1, "sensitive-file-added") in got
    assert not any(p == "old.py" for p, _, _ in got)
    assert ("src/a.ts", None, "auth-decorator-stripped") in got


def small(spark, files):
    rows = [("c", p, "modified", "add", i, i, t) for p, body in files.items() for i, t in enumerate(body, 1)]
    return spark.createDataFrame(rows, "change_set string, path string, status string, op string, pos bigint, line bigint, content string")


def test_frames_releases_and_groups(spark):
    df = small(spark, {
        "a.ts": ["for (const x of xs) {", "  await db.findOne(x)", "}", "emitter.on('x', f)", "foo().then(a)", "other()", "more()", "// @ts-ignore @ts-nocheck"],
        "b.ts": ["emitter.on('x', f)", "emitter.off('x', f)", "foo().then(a)", ".catch(b)", "const formatDate = 1", "id = req.body.id", "eval(id)"],
        "c.ts": ["const formatDate = 2", "query(id)"],
    })
    got = {(r["path"], r["line"], r["kind"]): r["severity"] for r in dt.findings(df).collect()}
    assert ("a.ts", 1, "n-plus-1-query") in got and ("a.ts", 4, "unsubscribed-listener") in got and ("b.ts", 1, "unsubscribed-listener") not in got
    assert ("a.ts", 5, "unhandled-promise") in got and ("b.ts", 3, "unhandled-promise") not in got
    assert got["a.ts", 8, "ts-directive"] == "critical"
    assert ("b.ts", 5, "divergent-utility") in got
    assert got["b.ts", 7, "taint-trace"] == "critical" and got["c.ts", 2, "taint-trace"] == "warning"


def test_imports(spark):
    df = small(spark, {"src/a.ts": ["import { b } from './b'", "const c = require('../lib/c.js')", "import { a } from './a'", "import x from 'pkg'"]})
    assert {(r["source"], r["target"], r["kind"]) for r in diffs.import_edges(df).collect()} == {("src/a", "src/b", "import"), ("src/a", "lib/c", "require")}


def test_stores(spark, tmp_path):
    schema = stores.SCHEMAS["deliveries"]
    assert stores.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "log.jsonl").write_text('{"key":"a","seen_at":"2024-01-01T00:00:00Z"}\nnot json\n{"key":"b"}\n')
    assert sorted(r["key"] for r in stores.read_jsonl(spark, str(tmp_path / "log.jsonl"), schema).collect()) == ["a", "b"]
    (tmp_path / "runs").mkdir()
    for n in "ab":
        (tmp_path / "runs" / f"{n}.json").write_text('{"key": "%s"}' % n)
    assert [r["run_id"] for r in stores.read_runs(spark, str(tmp_path / "runs"), schema).collect()] == ["a", "b"]
    stores.write_log(stores.read_jsonl(spark, str(tmp_path / "log.jsonl"), schema), str(tmp_path / "out"), ["key"], 1)
    assert [r["key"] for r in stores.read_jsonl(spark, str(tmp_path / "out"), schema).collect()] == ["a"]
    report = '[{"filePath":"x.js","messages":[{"line":3,"severity":2,"ruleId":"no-eval","message":"m"}]}]'
    assert [tuple(r) for r in stores.eslint_findings(spark.createDataFrame([(report,), ("bad",)], "report string")).collect()] == [("x.js", 3, "high", "no-eval", "m")]
    assert stores.compiler_findings(spark.createDataFrame([("a.ts(3,4): error TS1: no",), ("x",)], "text string")).head()["line"] == 3


def test_texts():
    yaml = "rules:\n  - name: a\n    pattern: 'x+'\n    enabled: false\n  - name: b\n    pattern: y  # note\n    tags: [1, two]\n  - pattern: unnamed\nother: 1.5\n"
    assert [(r["name"], r["enabled"], r["pattern"]) for r in texts.parse_rules(yaml)] == [("a", False, "x+"), ("b", True, "y")]
    assert texts.parse_owners("# c\n*.js @a @b\n/docs/ d@e.f # x\n!*.md\n") == [("*.js", ["@a", "@b"]), ("/docs/", ["d@e.f"]), ("*.md", [])]
    model = texts.parse_architecture("layers:\n  - name: ui\n    patterns: [src/ui/**]\n    allowed: [core]\n  - name: core\n    patterns:\n      - src/core/**\nstrict: true\n")
    assert model["layers"] == [("ui", ["src/ui/**"]), ("core", ["src/core/**"])] and model["allowed"] == {"ui": ["core"], "core": []} and model["strict"]
    adr = texts.parse_decision("# 7. No moment\n## Status\nAccepted\n## Decision\nDo not use `moment`, avoid lodash.\n")
    assert (adr["number"], adr["status"], adr["forbidden"]) == (7, "accepted", ["lodash", "moment"])
    assert texts.acceptance_criteria("- [x] one\n- [ ] two\n## Acceptance criteria\n1. three\n") == [(True, "one"), (False, "two"), (False, "three")]
    assert texts.front_matter("---\nname: s\n---\nbody") == ({"name": "s"}, "body") and texts.parse_yaml("") == {}


def test_sinks(spark):
    import json

    rows = [("c", "f.ts", 0, "critical", "bug", "a|b"), ("c", "f.ts", 3, "low", "style", "m")]
    f = spark.createDataFrame(rows, "change_set string, file string, line int, severity string, category string, message string")
    doc = json.loads(sinks.sarif(f).head()["document"])
    assert doc["version"] == "2.1.0" and [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"] and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert [r["batch"] for r in sinks.annotation_batches(f, ["line"], 1).orderBy("line").collect()] == [0, 1]
    assert "a\\|b" in sinks.markdown_table(f) and "<td>a|b</td>" in sinks.html_page("t", {"x": f})
    assert sinks.mermaid(spark.createDataFrame([("a", "b")], "source string, target string")).startswith("graph LR")

import re

import pytest
from pyspark.sql import functions as F

from heddle.functions import globs, hashing, numbers, severity, text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def plain_h31(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return abs(h)


def test_hashes(spark):
    given = ["", "a", "hello", "café", "日本", "x" * 200]
    got = values(spark, [(s,) for s in given], "s string", hashing.h31(F.col("s")), hashing.fnv1a32(F.col("s")), hashing.h31_base36(F.col("s")))
    assert [g[0] for g in got] == [plain_h31(s) for s in given] and got[2][0] == 99162322
    assert got[2][1] == "4f9f2cab" and got[0][1] == "811c9dc5" and got[0][2] == "0"


def test_rounding(spark):
    got = values(spark, [(-0.5,), (0.5,), (1.5,), (2.5,)], "x double", numbers.round_half_up(F.col("x")))
    assert [g[0] for g in got] == [0, 1, 2, 3]
    assert values(spark, [(0.005,)], "x double", numbers.round_half_up(F.col("x"), 2)) == [(0.01,)]


@pytest.mark.parametrize(
    ("glob", "dialect", "yes", "no"),
    [
        ("src/**/*.ts", "path", ["src/a.ts", "src/x/y/a.ts"], ["a.ts", "src/.h/a.ts", "src/a.js"]),
        ("*.{js,ts}", "path", ["a.js", "b.ts"], ["x/a.js", ".a.js", "a.py"]),
        ("**", "path", ["a", "a/b"], [".a"]),
        ("src/*.ts", "star", ["src/a.ts"], ["src/x/a.ts", "xsrc/a.ts"]),
        ("*.js", "owners", ["a.js", "x/y/a.js"], ["a.jsx"]),
        ("/docs/", "owners", ["docs/a", "docs/x/y"], ["docs", "x/docs/a"]),
        ("apps/*/x", "owners", ["apps/a/x", "apps/a/x/y"], ["apps/a/b/x", "z/apps/a/x"]),
        ("[!a]*.md", "owners", ["b.md"], ["a.md"]),
        ("**", "double", ["", "a/b"], []),
        ("src/**/x*", "double", ["src/a/b/xy"], ["src/x/y/a"]),
    ],
)
def test_globs(glob, dialect, yes, no):
    p = globs.glob_to_regex(glob, dialect)
    assert [s for s in yes if not re.search(p, s)] == [] and [s for s in no if re.search(p, s)] == []


def test_texts(spark):
    assert values(spark, [("^1.2.3", "2.0.0"), ("1.2.3", "1.3.0"), ("1.2.3", "1.2.2"), ("x", "y"), (None, "1.0.0"), ("1.0.0", None)], "a string, b string", text.version_change(F.col("a"), F.col("b"))) == [
        ("bumped-major",), ("bumped-minor",), ("downgraded",), ("bumped-minor",), ("added",), ("removed",),
    ]
    assert values(spark, [("a/b/c.ts",)], "p string", text.ancestors(F.col("p")), text.base_name(F.col("p")), text.directory(F.col("p")), text.strip_extension(F.col("p"))) == [(["a", "a/b"], "c.ts", "a/b", "a/b/c")]
    assert values(spark, [("a/b", "../x/./y",)], "d string, t string", text.resolve_relative(F.col("d"), F.col("t"))) == [("a/x/y",)]
    assert values(spark, [("", ""), ("abcd", "abce")], "a string, b string", text.similarity(F.col("a"), F.col("b"))) == [(1.0,), (0.75,)]
    assert values(spark, [("fix the bug", "the bug fix now"), ("a", "z")], "a string, b string", text.token_set_ratio(F.col("a"), F.col("b")))[0] == (1.0,)
    assert values(spark, [("aab",), ("",)], "t string", F.round(text.entropy(F.col("t")), 4)) == [(0.9183,), (0.0,)]
    assert values(spark, [("a b c d e",), ("a b",)], "t string", F.size(text.shingles(F.col("t")))) == [(1,), (0,)]
    assert values(spark, [("@s/p/x",), ("q/z",)], "n string", text.package_root(F.col("n"))) == [("@s/p",), ("q",)]
    assert values(spark, [("see #12 and AB-3, #12",)], "t string", text.issue_references(F.col("t"))) == [(["#12", "AB-3"],)]
    assert values(spark, [("x" * 100,)], "t string", F.length(text.head_and_tail(F.col("t"), 50))) == [(55,)]
    assert values(spark, [("<!-- <!-- a -->b",)], "t string", text.strip_html_comments(F.col("t"))) == [("b",)]
    assert values(spark, [("exportUser", "exportUsers"), ("ab", "xy"), ("abcdefg", "zzzzzzz")], "a string, b string", text.likely_rename(F.col("a"), F.col("b"))) == [(True,), (True,), (False,)]


def test_severities(spark):
    got = values(spark, [("critical",), ("nitpick",), ("odd",), (None,)], "s string", severity.ordinal(F.col("s")), severity.shift(F.col("s"), F.lit(-1)), severity.shift(F.col("s"), F.lit(1)))
    assert got == [(4, "high", "critical"), (0, "nitpick", "low"), (None, "odd", "odd"), (None, None, None)]


def test_weeks(spark):
    got = values(spark, [("2024-01-01 00:00:00",), ("2024-01-31 12:00:00",)], "t string", numbers.week_key(F.col("t").cast("timestamp")), numbers.iso_week_key(F.col("t").cast("timestamp")))
    assert got == [("2024-W01", "2024-W01"), ("2024-W05", "2024-W05")]

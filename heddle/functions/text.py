"""Text, path and version expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Addresses outside the allowed hosts.
OUTSIDE = r"https?:\/\/(?!github\.com|docs\.github\.com)[^\s)\]]+"
# What is redacted and by which marker, in order.
REDACTIONS = (
    (r"(?i)<img\b[^>]*>", "[REDACTED:IMG_TAG]"),
    (r"sk-[a-zA-Z0-9]{20,}", "[REDACTED:API_KEY]"),
    (r"sk-ant-api[a-zA-Z0-9_-]{20,}", "[REDACTED:ANTHROPIC_KEY]"),
    (r"ghp_[a-zA-Z0-9]{36}", "[REDACTED:GITHUB_TOKEN]"),
    (r"gho_[a-zA-Z0-9]{36}", "[REDACTED:GITHUB_OAUTH]"),
    (r"ghu_[a-zA-Z0-9]{36}", "[REDACTED:GITHUB_USER_TOKEN]"),
    (r"ghs_[a-zA-Z0-9]{36}", "[REDACTED:GITHUB_APP_TOKEN]"),
    (r"ghc_[a-zA-Z0-9]{36}", "[REDACTED:GITHUB_APP_CLIENT]"),
    (r"AKIA[A-Z0-9]{16}", "[REDACTED:AWS_KEY]"),
    (r"eyJ[A-Za-z0-9_-]{100,}", "[REDACTED:JWT]"),
    (OUTSIDE, "[REDACTED:EXTERNAL_URL]"),
    (r"(?:curl|wget|nc|ncat|bash|sh|python3?|node|ruby|perl)\s+[^\n]+", "[REDACTED:SHELL_CMD]"),
)
COMMENT = r"(?s)<!--.*?-->"


def redact(c: Column) -> Column:
    for pattern, by in REDACTIONS:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip_html_comments(c: Column) -> Column:
    """Removes comments, and what their removal forms anew, until none is left: each round takes one opening at least."""
    openings = F.regexp_count(c, F.lit("<!--"))
    rounds = F.when(openings > 0, F.sequence(F.lit(1), openings)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, c, lambda left, _: F.when(left.contains("-->"), F.regexp_replace(left, COMMENT, "")).otherwise(left))


def strip_people(patch: Column) -> Column:
    """A patch without names, dates and object ids in its headers."""
    patch = F.regexp_replace(patch, r"(?m)^index [0-9a-f]+\.\.[0-9a-f]+.*$", "index [REDACTED]")
    patch = F.regexp_replace(patch, r"(?m)^(From|Author|Date): .*$\n?", "")
    return F.regexp_replace(patch, r"(?m)^commit [0-9a-f]{7,40}$", "commit [REDACTED]")


def strip_markers(body: Column) -> Column:
    """A comment's words: without its bold head, suggestion blocks, editor links and tags."""
    for pattern in (r"\*\*\[\w+\]\s*\w+\*\*:\s*", r"(?s)```suggestion.*?```", r"\[Open in VS Code\].*", "<[^>]*>"):
        body = F.regexp_replace(body, pattern, "")
    return F.trim(body)


def fenced_json(answer: Column, schema: str) -> Column:
    """The JSON object of a free answer, fenced or bare, by schema; null where it can't be read."""
    inner = F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    got = F.from_json(F.when(answer.contains("```"), inner).otherwise(F.trim(answer)), schema + ", __hd_bad string", {"columnNameOfCorruptRecord": "__hd_bad"})
    return F.when(got["__hd_bad"].isNull(), got)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n.cast("bigint"), 0)


def short_number(n: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M; below a thousand as it is."""
    tenths = lambda x: F.format_string("%.1f", F.floor(x / 100 + 0.5) / 10)
    return F.when(n >= 1_000_000, F.concat(tenths(n / 1000), F.lit("M"))).when(n >= 1000, F.concat(tenths(n), F.lit("K"))).otherwise(n.cast("string"))


def collapse_repeats(c: Column, least: int = 10) -> Column:
    """A character repeated `least` times or more is kept three times."""
    return F.regexp_replace(c, r"(?s)(.)\1{%d,}" % (least - 1), "$1$1$1")


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty text."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    part = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(n > 0, -F.aggregate(part, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(F.lit(0.0))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def head_and_tail(c: Column, budget: int, marker: str = "\n...\n") -> Column:
    """The first 70 % and the last 30 % of the budget of characters where a text exceeds it."""
    head = int(budget * 0.7)
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(budget - head))))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def first_segments(path: Column, k: int) -> Column:
    return F.substring_index(path, "/", k)


def ancestors(path: Column) -> Column:
    """All directories above a path, longest last."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def resolve_relative(base_dir: Column, target: Column) -> Column:
    """base_dir joined with a relative path, `.` and `..` folded."""
    parts = F.split(F.concat(base_dir, F.lit("/"), target), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def package_root(name: Column) -> Column:
    """`@scope/name/x` gives `@scope/name`, `name/x` gives `name`."""
    return F.when(name.startswith("@"), F.substring_index(name, "/", 2)).otherwise(F.substring_index(name, "/", 1))


def semver(version: Column) -> Column:
    """struct(major, minor, patch) of a version without its range sign, null where it is none."""
    v = F.regexp_replace(version, r"^[\^~>=<\s]+", "")
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)", i), F.lit("")), F.lit("999999999")).cast("int")
    return F.when(v.rlike(r"^\d+\.\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def version_change(old: Column, new: Column) -> Column:
    """added, removed, bumped-major, bumped-minor, bumped-patch or downgraded."""
    a, b = semver(old), semver(new)
    return (
        F.when(old.isNull(), "added")
        .when(new.isNull(), "removed")
        .when(a.isNull() | b.isNull(), "bumped-minor")
        .when(b < a, "downgraded")
        .when(b["major"] > a["major"], "bumped-major")
        .when(b["minor"] > a["minor"], "bumped-minor")
        .otherwise("bumped-patch")
    )


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of token sets by edit distance: the best of shared tokens against shared and own tokens."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != "")))
    x, y = words(a), words(b)
    both = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    one = F.trim(F.concat_ws(" ", both, F.array_join(F.array_except(x, y), " ")))
    two = F.trim(F.concat_ws(" ", both, F.array_join(F.array_except(y, x), " ")))
    return F.greatest(F.when(F.length(both) > 0, similarity(both, one)).otherwise(F.lit(0.0)), F.when(F.length(both) > 0, similarity(both, two)).otherwise(F.lit(0.0)), similarity(one, two))


def likely_rename(a: Column, b: Column) -> Column:
    """A common beginning of three characters and lengths within two, or two edits where both are short."""
    return ((F.substring(a, 1, 3) == F.substring(b, 1, 3)) & (F.length(a) >= 3) & (F.length(b) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 2)) | (
        (F.length(a) <= 6) & (F.length(b) <= 6) & (F.levenshtein(a, b, 2) >= 0)
    )


def word_grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces; the words' expression is evaluated once."""

    def grams(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))

    return F.get(F.transform(F.array(words), grams), F.lit(0))


def shingles(c: Column, n: int = 4) -> Column:
    """Distinct word n-grams after literals, numbers and one-letter names are made alike."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"\"[^\"]*\"|'[^']*'", "STR"), r"\b\d+(\.\d+)?\b", "NUM")
    return F.array_distinct(word_grams(F.filter(F.split(F.regexp_replace(s, r"\b[a-z]\b", "V"), r"\s+"), lambda x: x != ""), n))


def issue_references(c: Column) -> Column:
    """Distinct `#12` and `ABC-12` references."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(#\d+|\b[A-Z][A-Z0-9]+-\d+\b)"), F.lit(1)))

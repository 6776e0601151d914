"""Four glob dialects, translated to anchored regular expressions when a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str, dialect: str = "path") -> str:
    """dialect `path`: `**`, `*`, `?`, braces and classes, dotfiles only by name; `star`: only `*`, within a segment;
    `owners`: anchored at the root or floating, matching a file or all below a directory; `double`: `*` and `**`."""
    return {"path": _path, "star": _star, "owners": _owners, "double": _double}[dialect](glob)


def _star(glob: str) -> str:
    return "^" + "[^/]*".join(re.escape(p) for p in glob.split("*")) + "$"


def _double(glob: str) -> str:
    if glob == "**":
        return "^.*$"
    return "^" + ".*".join("[^/]*".join(re.escape(x) for x in part.split("*")) for part in glob.split("**")) + "$"


def _segment(s: str, dots: bool) -> str:
    """One path segment; a leading wildcard does not match a dot unless dots is set."""
    out, i, depth = "", 0, 0
    while i < len(s):
        c = s[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := s.find("]", i + 2)) > 0:
            body = s[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and "}" in s[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return ("" if dots or not s or s[0] not in "*?[" else r"(?!\.)") + out


def _path(glob: str) -> str:
    out = ""
    parts = glob.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)?" if last else r"(?:(?!\.)[^/]+/)*"
        else:
            out += _segment(p, False) + ("" if last else "/")
    return "^" + out + "$"


def _owners(glob: str) -> str:
    anchored, body = glob.startswith("/") or "/" in glob.rstrip("/"), glob.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 1)) > 0:
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    below = "/.*" if glob.endswith("/") else "(?:/.*)?"
    return ("^" if anchored else "^(?:.*/)?") + out + below + "$"


def matches_any(path: Column, globs: list[str], dialect: str = "path") -> Column:
    """True where any glob fits; no globs fit nothing."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_to_regex(g, dialect)})" for g in globs))

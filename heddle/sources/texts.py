"""Small configuration texts, parsed on the driver: rule lists, code owners, architecture models, decisions, criteria.

These are files of a repository that a person wrote; they are bounded by MAX_CHARS and become literals of plans.
"""

from __future__ import annotations

import re

MAX_CHARS = 1_000_000


def _lines(text: str) -> list[str]:
    if len(text) > MAX_CHARS:
        raise ValueError(f"a configuration text of {len(text)} characters; {MAX_CHARS} at most")
    return text.splitlines()


def scalar(value: str):
    """true, false, null, a number, a quoted or bare text, or a bracketed list of those."""
    v = value.strip()
    if v.startswith("[") and v.endswith("]"):
        return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "'\"":
        return v[1:-1]
    v = re.sub(r"\s+#.*$", "", v)
    if v in ("true", "false"):
        return v == "true"
    if v in ("", "null", "~"):
        return None
    return int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v


def parse_yaml(text: str):
    """A subset: nested maps by indentation, lists of scalars or maps, comments."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in _lines(text) if x.strip() and not x.strip().startswith("#")]

    def block(i: int, depth: int):
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            out: list = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1].startswith("-"):
                rest = rows[i][1][1:].strip()
                if re.match(r"[\w.-]+:(\s|$)", rest):
                    inner = depth + len(rows[i][1]) - len(rest)
                    rows[i] = (inner, rest)
                    value, i = block(i, inner)
                else:
                    value, i = scalar(rest), i + 1
                out.append(value)
            return out, i
        got: dict = {}
        while i < len(rows) and rows[i][0] == depth and not rows[i][1].startswith("- "):
            key, _, rest = rows[i][1].partition(":")
            i += 1
            if rest.strip():
                got[key.strip().strip("'\"")] = scalar(rest)
            elif i < len(rows) and (rows[i][0] > depth or rows[i][0] == depth and rows[i][1].startswith("- ")):
                got[key.strip().strip("'\"")], i = block(i, rows[i][0])
            else:
                got[key.strip().strip("'\"")] = None
        return got, i

    return block(0, rows[0][0])[0] if rows else {}


def parse_rules(text: str) -> list[dict]:
    """Rules with name and pattern; what is absent is enabled, of medium severity and style, with confidence 80."""
    found = parse_yaml(text)
    rules = found.get("rules", []) if isinstance(found, dict) else found
    default = {"severity": "medium", "category": "style", "enabled": True, "confidence": 80, "type": "regex"}
    return [default | {k: v for k, v in r.items() if v is not None} for r in rules or [] if isinstance(r, dict) and r.get("name") and r.get("pattern")]


def parse_owners(text: str) -> list[tuple[str, list[str]]]:
    """(glob, owners) in file order; a pattern without owners, or with a leading `!`, clears."""
    out = []
    for x in _lines(text):
        parts = re.sub(r"(^|\s)#.*$", "", x).split()
        if parts:
            negative = parts[0].startswith("!")
            out.append((parts[0].lstrip("!"), [] if negative else [p for p in parts[1:] if p.startswith("@") or "@" in p]))
    return out


def parse_architecture(text: str) -> dict:
    """layers: list of (name, globs); allowed: name -> names; contexts: list of (name, globs)."""
    m = parse_yaml(text)
    pick = lambda k: [(x["name"], x.get("patterns") or x.get("paths") or []) for x in m.get(k) or []]
    return {"layers": pick("layers"), "contexts": pick("contexts"), "allowed": {x["name"]: x.get("allowed") or [] for x in m.get("layers") or []}, "strict": bool(m.get("strict"))}


def sections(text: str) -> dict[str, str]:
    """Markdown headings of any depth, lower-cased, with their bodies."""
    out, at = {}, ""
    for x in _lines(text):
        if h := re.match(r"#{1,6}\s+(.*?)\s*#*$", x):
            at = h[1].lower()
            out.setdefault(at, "")
        elif at:
            out[at] += x + "\n"
    return {k: v.strip() for k, v in out.items()}


def parse_decision(text: str) -> dict:
    """Title, number, status and forbidden terms of an architecture decision record."""
    s = sections(text)
    title = re.search(r"^#\s+(.*)$", text, re.M)
    number = re.search(r"(\d+)", title[1]) if title else None
    body = s.get("decision", "")
    terms = re.findall(r"(?i)(?:do not use|must not use|avoid|never use|instead of)\s+[`'\"]?([\w./-]*\w)", body)
    return {"number": int(number[1]) if number else None, "title": title[1] if title else "", "status": s.get("status", "").split("\n")[0].strip().lower(), "decision": body, "forbidden": sorted({t.lower() for t in terms})}


def acceptance_criteria(text: str) -> list[tuple[bool, str]]:
    """Task-list items and numbered items under a heading on acceptance criteria, in order, as (done, text)."""
    out = [(m[1].lower() == "x", m[2].strip()) for m in re.finditer(r"(?m)^\s*[-*]\s+\[([ xX])\]\s+(.*)$", text)]
    body = next((v for k, v in sections(text).items() if "acceptance" in k or "criteria" in k), "")
    return out + [(False, m[1].strip()) for m in re.finditer(r"(?m)^\s*(?:\d+[.)]|[-*](?!\s*\[))\s+(.*)$", body)]


def front_matter(text: str) -> tuple[dict, str]:
    """The map between leading `---` lines, and the rest."""
    m = re.match(r"\A---\n(.*?)\n---\n?(.*)\Z", text, re.S)
    return (parse_yaml(m[1]), m[2]) if m else ({}, text)

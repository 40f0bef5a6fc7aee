"""Ignore-file wildcard rules compiled to regular expressions.

The rule list is driver-side configuration (a handful of lines); the matching runs
on the executors as ``rlike`` expressions, so no rule table is joined per row.
Generated patterns avoid look-around, so the same text runs under Java regex and
RE2 (used by the SQL oracle).

Grammar: blank lines and ``#`` comments are skipped; ``!`` negates; a trailing ``/``
matches a directory and everything below it; a slash at the start or in the middle
anchors the rule at the root, otherwise it matches at any depth; ``*`` and ``?``
never cross ``/``; ``**`` spans directories; ``[...]`` is a character class
(``[!...]`` negated). The last matching rule wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Always ignored, as in the reference's project walk.
ALWAYS_IGNORED = (".git/",)

# Default ignore groups of the scan dialog (fixed values).
DEFAULT_GROUPS = {
    "venv": [".venv/", "venv/", "env/"],
    "pycache": ["__pycache__/", "*.pyc", "dist/", "build/", "*.egg-info/"],
    "git": [".git/", ".vscode/", ".idea/"],
    "node": ["node_modules/"],
}


@dataclass(frozen=True)
class Rule:
    idx: int
    regex: str
    ignore: bool  # False for a negated ("!") rule


def _glob_segment(seg: str) -> str:
    out, i, n = [], 0, len(seg)
    while i < n:
        c = seg[i]
        if c == "\\" and i + 1 < n:
            out.append(re.escape(seg[i + 1]))
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = seg.find("]", i + 2 if i + 1 < n and seg[i + 1] in "!^" else i + 1)
            if j == -1:
                out.append(r"\[")
            else:
                body = seg[i + 1 : j]
                neg = body[:1] in ("!", "^")
                if neg:
                    body = body[1:]
                body = body.replace("\\", "\\\\")
                out.append("[" + ("^" if neg else "") + body + "]")
                i = j + 1
                continue
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def compile_rule(line: str, idx: int = 0) -> Rule | None:
    s = line.rstrip("\n").rstrip("\r")
    while s.endswith(" ") and not s.endswith("\\ "):
        s = s[:-1]
    if not s or s.startswith("#"):
        return None
    ignore = True
    if s.startswith("!"):
        ignore, s = False, s[1:]
    elif s.startswith("\\!") or s.startswith("\\#"):
        s = s[1:]
    dir_only = s.endswith("/")
    s = s.rstrip("/")
    if not s:
        return None
    anchored = "/" in s
    s = s.lstrip("/")
    segs = s.split("/")
    body = []
    for i, seg in enumerate(segs):
        last = i == len(segs) - 1
        if seg == "**":
            body.append(".*" if last else "(?:[^/]*/)*")
        else:
            body.append(_glob_segment(seg) + ("" if last else "/"))
    head = "^" if anchored or segs[0] == "**" else "^(?:.*/)?"
    if segs[-1] == "**":
        tail = "$"
    elif dir_only:
        tail = "/.*$"
    else:
        tail = "(?:/.*)?$"
    return Rule(idx, head + "".join(body) + tail, ignore)


def compile_rules(lines, always=ALWAYS_IGNORED) -> list[Rule]:
    rules = []
    for line in list(lines) + list(always):
        r = compile_rule(line, len(rules))
        if r is not None:
            rules.append(r)
    return rules


def matches(path: Column, rules: list[Rule]) -> Column:
    """Last matching rule decides; no match -> not ignored."""
    if not rules:
        return F.lit(False)
    expr = None
    for r in reversed(rules):
        expr = (F.when(path.rlike(r.regex), F.lit(r.ignore)) if expr is None else expr.when(path.rlike(r.regex), F.lit(r.ignore)))
    return expr.otherwise(F.lit(False))


def dir_prefixes(path: Column) -> Column:
    """['a/', 'a/b/'] for 'a/b/c.txt'."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))


def ignored(path: Column, rules: list[Rule]) -> Column:
    """A file is ignored when it matches, or when any parent directory does (an
    ignored directory is pruned whole and cannot be re-included)."""
    return F.exists(dir_prefixes(path), lambda d: matches(d, rules)) | matches(path, rules)


# ---- SQL text of the same predicate, for the DuckDB oracle ----

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_matches(x: str, rules: list[Rule]) -> str:
    if not rules:
        return "false"
    whens = " ".join(
        f"WHEN regexp_matches({x}, {_sql_str(r.regex)}) THEN {'true' if r.ignore else 'false'}" for r in reversed(rules)
    )
    return f"(CASE {whens} ELSE false END)"


def sql_ignored(path: str, rules: list[Rule]) -> str:
    prefixes = (
        f"list_transform(range(1, len(string_split({path}, '/'))), "
        f"lambda i: array_to_string(string_split({path}, '/')[1:i], '/') || '/')"
    )
    return f"(coalesce(list_bool_or(list_transform({prefixes}, lambda d: {sql_matches('d', rules)})), false) OR {sql_matches(path, rules)})"

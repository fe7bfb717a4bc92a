"""Glob patterns as regular expressions over whole paths.

`*` and `?` match `/` too. `**/`, `/**/` and `/**` match any number of directories, `[a-z]` and `[!a]`
a character, `{a,b}` either branch, and a backslash takes away a character's meaning.
"""

from __future__ import annotations

import re

from .errors import GlobFailure

#: The patterns of generated sources.
GENERATED = ["**/target/**", "**/OUT_DIR/**", "**/*bindings*.rs", "**/*pb*.rs"]


def glob_regex(pattern: str) -> str:
    out, i, depth, n = [], 0, 0, len(pattern)
    if pattern == "**":
        return "^.*$"
    while i < n:
        c = pattern[i]
        at_edge = i == 0 or pattern[i - 1] == "/"
        if c == "*" and pattern.startswith("**", i) and at_edge and (i + 2 == n or pattern[i + 2] == "/"):
            if i + 2 == n:  # after a slash that is out already: everything below
                out.append(".*")
                i += 2
            elif i == 0:
                out.append("(?:/?|.*/)")
                i += 3
            else:
                out.append("(?:|.*/)")
                i += 3
        elif c == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise GlobFailure(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}":
            if not depth:
                raise GlobFailure(f"unopened alternative in {pattern!r}")
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 == n:
                raise GlobFailure(f"dangling escape in {pattern!r}")
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    if depth:
        raise GlobFailure(f"unclosed alternative in {pattern!r}")
    return "(?s)^" + "".join(out) + "$"

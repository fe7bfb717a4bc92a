"""Tokens of Rust source text with positions, and the printer of token text."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class SourceError(ValueError):
    """Text that is not a Rust source file; line is 1-based."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(message if line is None else f"line {line}: {message}")
        self.line = line


class Token(NamedTuple):
    kind: str  # ident, life, lit, doc, idoc, punct, open, close
    text: str
    start: int  # offsets in the text
    end: int


_TOKEN = re.compile(
    r"""
    \s*(?:
    (?P<word>[^\W\dbcr]\w*)                       # no literal's prefix: the most frequent tokens come first
  | (?P<punct>[~!@\#$%^&*\-=+|;:,<.>?])
  | (?P<open>[(\[{])
  | (?P<close>[)\]}])
  | (?P<idoc>//![^\n]*|/\*!(?:[^*]|\*(?!/))*\*/)
  | (?P<doc>///(?!/)[^\n]*|/\*\*(?![*/])(?:[^*]|\*(?!/))*\*/)
  | (?P<line>//[^\n]*)
  | (?P<block>/\*)
  | (?P<raw>(?:br|cr|r)(?P<hashes>\#*)")
  | (?P<str>[bc]?"(?:[^"\\]|\\.)*")
  | (?P<char>b?'(?:[^'\\\n]|\\(?:u\{[^}']*\}|x[0-9A-Fa-f]{2}|.))')
  | (?P<life>'(?:r\#)?[^\W\d]\w*)
  | (?P<num>0[xob][0-9A-Fa-f_]+\w*|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*))
  | (?P<ident>(?:r\#)?[^\W\d]\w*)
  | (?P<slash>/)
  | (?P<space>\Z)
    )
    """,
    re.X | re.S,
)
_SPACE, _SUFFIX, _COMMENT_ENDS = re.compile(r"\s*"), re.compile(r"\w*"), re.compile(r"/\*|\*/")
_SKIPPED = {"line", "block", "space"}
_CLOSER = {"(": ")", "[": "]", "{": "}"}


class Source:
    """A lexed file: the tokens' kinds, texts and starts, the index of each opening token's partner, and line numbers."""

    def __init__(self, text: str):
        text = text.removeprefix("﻿")
        if text.startswith("#!") and not re.match(r"#!\s*\[", text):
            line = text.find("\n")
            text = " " * (len(text) if line < 0 else line) + text[len(text) if line < 0 else line :]
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.partner: dict[int, int] = {}
        self.touching: list[int] = []  # punctuation just after other punctuation
        self.colons = False  # whether a literal or a comment that is kept has ::
        self._lex()

    @property
    def tokens(self) -> list[Token]:
        return [Token(k, t, at, at + len(t)) for k, t, at in zip(self.kinds, self.texts, self.starts)]

    def _lex(self) -> None:
        text, at, n, mark_end = self.text, 0, len(self.text), -1
        kinds, texts, starts, opened = self.kinds, self.texts, self.starts, []
        add_kind, add_text, add_start, match = kinds.append, texts.append, starts.append, _TOKEN.match
        while at < n:
            found = match(text, at)
            if not found:
                at = _SPACE.match(text, at).end()
                raise SourceError(f"unexpected character {text[at]!r}", self.position(at)[0])
            kind, end = found.lastgroup, found.end()
            if kind == "hashes":
                kind = "raw"
            token = found[kind]
            at = end - len(token)  # without the space before it
            if kind == "word":
                kind = "ident"
            elif kind == "punct" or kind == "slash":
                if at == mark_end:
                    self.touching.append(len(kinds))
                kind, mark_end = "punct", end
            elif kind == "ident":
                pass
            elif kind == "open":
                opened.append(len(kinds))
            elif kind == "close":
                if not opened or _CLOSER[texts[opened[-1]]] != token:
                    raise SourceError(f"unmatched {token}", self.position(at)[0])
                self.partner[opened.pop()] = len(kinds)
            elif kind in ("str", "char", "num"):
                if kind != "num":
                    end = _SUFFIX.match(text, end).end()
                    token = text[at:end]
                kind = "lit"
                self.colons |= "::" in token
            elif kind == "raw":
                close = text.find('"' + found["hashes"], end)
                if close < 0:
                    raise SourceError("unterminated raw string", self.position(at)[0])
                end = close + 1 + len(found["hashes"])
                end = _SUFFIX.match(text, end).end()
                kind, token = "lit", text[at:end]
                self.colons |= "::" in token
            elif kind == "doc" or kind == "idoc" or kind == "block":
                self.colons |= "::" in token
            if kind == "block" or kind in ("doc", "idoc") and text[at + 1] == "*" and "/*" in token[2:]:
                depth, end = 1, at + 2  # comments nest
                while depth:
                    step = _COMMENT_ENDS.search(text, end)
                    if not step:
                        raise SourceError("unterminated comment", self.position(at)[0])
                    depth += 1 if step[0] == "/*" else -1
                    end = step.end()
                token = text[at:end]
            if kind not in _SKIPPED:
                add_kind(kind)
                add_text(token)
                add_start(at)
            at = end
        if opened:
            raise SourceError(f"unclosed {texts[opened[-1]]}", self.position(starts[opened[-1]])[0])

    def position(self, offset: int) -> tuple[int, int]:
        """1-based line and 0-based column in characters."""
        line = bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1]


def token_text(tokens: list[Token], glued: set[int], first: int, stop: int) -> str:
    """Tokens first .. stop as joined() shows them."""
    return joined([t.kind for t in tokens], [t.text for t in tokens], glued, first, stop)


def joined(kinds: list[str], texts: list[str], glued: set[int], first: int, stop: int) -> str:
    """Tokens first .. stop with one space between them.

    There is none inside an operator of several characters (the indices in glued), just inside
    round and square brackets, or in empty braces.
    """
    if stop == first + 1 and kinds[first] == "ident":
        return texts[first]
    out: list[str] = []
    tight = True
    for i in range(first, stop):
        kind, text = kinds[i], texts[i]
        if kind == "close":
            if text == "}":
                out.append("}" if texts[i - 1] == "{" and kinds[i - 1] == "open" else " }")
            else:
                out.append(text)
            tight = False
            continue
        if not tight:
            out.append(" ")
        if kind == "open":
            out.append("{ " if text == "{" else text)
            tight = True
        else:
            out.append(text)
            tight = i in glued
    return "".join(out)

"""Pieces of one shape are parsed once: top-level items, the heads of functions, and statements of their bodies.

A shape is a piece's tokens without the texts of names, literals, lifetimes and doc comments that no rule of
the grammar looks at. The parser runs once over marks in their place; what it finds, as Python code with the
marks' tokens filled in, gives the facts of every later piece of the shape. All other pieces are parsed.
"""

from __future__ import annotations

import re
import sys
from functools import cache
from types import CodeType

from . import parser
from .lexer import Source, SourceError
from .parser import Facts, Parser

#: A shape's code is made when it has been seen this often; pieces of more tokens than LONGEST are always parsed.
SEEN, LONGEST, SHAPES = 16, 400, 8_192
_MARK = 0xF0000
_MARKS = re.compile("([\U000f0000-\U000f0fff])")
FIXED = {"punct", "open", "close"}
_FREE = {"ident": "\1", "lit": "\2", "life": "\3", "doc": "\4", "idoc": "\5"}
RELATIONS = ("functions", "imports", "exports", "macros_def", "macros_inv", "paths", "calls", "fn_spans")


def _texts(value) -> set[str]:
    """Every text in a constant or in code."""
    if isinstance(value, str):
        return {value}
    if isinstance(value, CodeType):
        value = value.co_consts
    return set().union(*map(_texts, value)) if isinstance(value, tuple | frozenset | set | list) else set()


#: Words that the parser compares with: all texts in its code.
WORDS = set().union(*(_texts(f.__code__) for f in vars(Parser).values() if hasattr(f, "__code__")), *(_texts(v) for k, v in vars(parser).items() if not k.startswith("__")))


class _At(str):
    """The name of a line or a column in the code."""


class _ShapeParser(Parser):
    def __init__(self, source: Source, crate: str):
        super().__init__(source, crate)
        self.places: set[str] = set()

    def place(self, i: int, end: bool = False) -> tuple[str, str]:
        at = f"{i}{'e' * end}"
        self.places.add(f"  l{at}, c{at} = position(s[{i}]{f' + len(t[{i}])' if end else ''})")
        return _At(f"l{at}"), _At(f"c{at}")


def _code(value) -> str:
    if isinstance(value, _At):
        return str(value)
    if isinstance(value, str):
        parts = [f"t[{ord(p) - _MARK}]" if _MARKS.fullmatch(p) else repr(p) for p in _MARKS.split(value) if p]
        return parts[0] if len(parts) == 1 else f"''.join(({', '.join(parts)}))" if parts else "''"
    if isinstance(value, list):
        return f"[{', '.join(map(_code, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k!r}: {_code(v)}" for k, v in value.items() if not k.startswith("_")) + "}"
    return repr(value)


class _Other(Exception):
    """The pieces aren't what they seemed."""


class Shapes:
    """Parses the files of one crate; relations: those wanted, all of them if not given."""

    def __init__(self, crate: str, relations: tuple[str, ...] | None = None):
        self.crate = crate
        self.wanted = [n for n in RELATIONS if relations is None or n in relations]
        self.seen: dict = {}

    def parse(self, text: str) -> Facts:
        """As parser.parse(); relations that aren't wanted may lack rows."""
        src = Source(text)
        if not src.colons and not (src.kinds and (src.kinds[0] == "idoc" or src.texts[:2] == ["#", "!"])):
            try:
                return self._pieces(src)
            except (SourceError, RecursionError, IndexError, KeyError, _Other):
                pass  # the parser says what is wrong
        return parser.parse_source(src, self.crate)

    def _pieces(self, src: Source) -> Facts:
        kinds, texts, starts, partner, position = src.kinds, src.texts, src.starts, src.partner, src.position
        shapes = [t if k in FIXED or k == "ident" and t in WORDS else _FREE[k] for k, t in zip(kinds, texts)]
        for i in src.touching:
            shapes[i] += "\6"
        facts, direct = Facts(), None
        lists = [getattr(facts, n) for n in RELATIONS]
        i, n = 0, len(kinds)
        while i < n:
            if kinds[i] == "idoc":
                i += 1
                continue
            at = i  # the item's end
            while texts[at] != ";" and texts[at] != "{":
                at = partner[at] + 1 if kinds[at] == "open" else at + 1
            if texts[at] == "{":
                close = partner[at]
                body = "fn" in shapes[i:at] and close > at + 1
                end = close + 1 if not body and close + 1 < n and texts[close + 1] == ";" else close
            else:
                body, end = False, at
            code = self._code("head" if body else "item", src, shapes, i, at if body else end)
            if code is None:
                direct = direct or _direct(src, self.crate, facts)
                direct.i = i
                direct.item()
                if direct.i != end + 1:
                    raise _Other
            elif body:
                fn, public = code([*texts[i : at + 1], "}"], [*starts[i : at + 1], starts[close]], position, None, None, *lists)
                at += 1
                while at < close:  # its statements, up to a ; each
                    first = at
                    while at < close and texts[at] != ";":
                        at = partner[at] + 1 if kinds[at] == "open" else at + 1
                    at = min(at + 1, close)
                    code = self._code("body", src, shapes, first, at - 1)
                    if code is not None:
                        code(texts[first:at], starts[first:at], position, fn, public, *lists)
                        continue
                    direct = direct or _direct(src, self.crate, facts)
                    direct.i, direct.fn, direct.fn_public, direct.in_body = first, fn, public, True
                    while direct.i < at:
                        direct.statement(close)
                    if direct.i != at:
                        raise _Other
                    direct.fn, direct.fn_public, direct.in_body = None, None, False
            else:
                code(texts[i : end + 1], starts[i : end + 1], position, None, None, *lists)
            i = end + 1
        return facts

    def _code(self, kind: str, src: Source, shapes: list[str], first: int, last: int):
        """The code of a piece's shape, or None."""
        if last - first >= LONGEST:
            return None
        shape = kind + "\0".join(shapes[first : last + 1])
        known = self.seen.get(shape, 0)
        if known.__class__ is not int:
            return known or None
        if known or len(self.seen) < SHAPES:
            self.seen[shape] = known + 1 if known < SEEN else self._made(kind, src, first, last)
        return None

    def _parsed(self, kind: str, src: Source, first: int, last: int) -> _ShapeParser | None:
        """The parser after the piece with marks in place of its free tokens; None if the piece alone doesn't parse."""
        if last - first >= LONGEST:
            return None
        piece = object.__new__(Source)
        texts = src.texts[first : last + 1]
        piece.kinds = src.kinds[first : last + 1]
        piece.texts = [t if k in FIXED or k == "ident" and t in WORDS else chr(_MARK + i) for i, (k, t) in enumerate(zip(piece.kinds, texts))]
        piece.starts = src.starts[first : last + 1]
        piece.partner = {a - first: b - first for a, b in src.partner.items() if first <= a and b <= last}
        piece.lines = [0]
        if kind == "head":  # with an empty body
            piece.partner[len(texts) - 1] = len(texts)
            piece.kinds.append("close")
            piece.texts.append("}")
            piece.starts.append(src.starts[src.partner[last]])
        made = _ShapeParser(piece, self.crate)
        try:
            if kind == "body":
                made.fn, made.fn_public, made.in_body = _At("fn"), _At("public"), True
                while made.i < made.n:
                    made.statement(made.n)
            else:
                made.item()
        except (SourceError, RecursionError, IndexError, KeyError):
            return None
        if made.i != made.n or kind == "head" and len(made.facts.fn_spans) != 1:
            return None
        return made

    def _made(self, kind: str, src: Source, first: int, last: int):
        """The code, or False if the piece alone doesn't parse."""
        made = self._parsed(kind, src, first, last)
        if made is None:
            return False
        rows = [f"  {n}.append({_code(r)})" for n in self.wanted for r in getattr(made.facts, n)]
        names = set(re.findall(r"\b[lc]\d+e?\b", "\n".join(rows)))
        code = ["def piece(t, s, position, fn, public, " + ", ".join(RELATIONS) + "):", *(p for p in sorted(made.places) if p.split()[0][:-1] in names), *rows]
        if kind == "head":
            span = made.facts.fn_spans[0]
            code.append(f"  return {_code(span['fq_name'])}, {span['is_public']}")
        elif len(code) == 1:
            code.append("  pass")
        space: dict = {}
        exec("\n".join(code), space)
        return space["piece"]


def _direct(src: Source, crate: str, facts: Facts) -> Parser:
    """The parser of the pieces whose shapes aren't known, into the same facts."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    out = Parser(src, crate)
    out.facts = facts
    return out


@cache
def shapes_of(crate: str, relations: tuple[str, ...]) -> Shapes:
    """One for all tasks of a worker."""
    return Shapes(crate, relations)

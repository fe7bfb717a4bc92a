"""Texts whose lines differ from known ones only in digits are neither lexed nor parsed.

A template is a text with a mark for each run of digits. Lines are put together until they are whole pieces, as
shapes.py cuts them: items, heads of functions, statements, the end of a body. A piece's template is lexed and parsed
once; what that finds, as Python code with the runs filled in, gives the facts of every later piece of the template.
Digits never move the ends of tokens, except between single quotes. Texts with any other piece are read by their shapes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from types import FunctionType

from .lexer import Source, SourceError
from .parser import Facts
from .shapes import _MARK, _MARKS, FIXED, RELATIONS, SEEN, WORDS, Shapes, _At

_RUN = re.compile("([0-9]+)")
#: Templates kept of pieces and of whole texts, and the characters of the longest.
TEMPLATES, LONG = 16_384, 1_000
#: Whole texts whose columns are known, their different rows, and the places of pieces in them.
WHOLES = 65_536
_MORE = True  # the entry of a piece that isn't whole yet; False: of one that is always parsed
_NUMBERED = {_RUN.sub("\0", w) for w in WORDS if _RUN.search(w)}


class _Refused(Exception):
    """A piece that has no template."""


class _Sum:
    """A number plus the lengths of runs."""

    def __init__(self, number: int, runs: tuple[int, ...]):
        self.number, self.runs = number, runs

    def __add__(self, other: int | _Sum) -> _Sum:
        return _Sum(self.number + other.number, self.runs + other.runs) if isinstance(other, _Sum) else _Sum(self.number + other, self.runs)

    __radd__ = __add__


@dataclass(frozen=True, slots=True)
class Whole:
    """What is known of all texts of one template: rows that differ in texts and numbers made of the runs only."""

    #: For each relation that has rows, the places of its rows in Templates.rows, and for each column that differs
    #: the places of its values among those of the file, -1 where the row has it.
    rows: dict[str, tuple[list[int], dict[str, list[int]]]]
    #: Code that gives the file's texts and numbers from its runs.
    texts: FunctionType | None
    numbers: FunctionType | None
    text_count: int
    number_count: int


class Templates(Shapes):
    """Shapes with templates before them."""

    def __init__(self, crate: str, relations: tuple[str, ...] | None = None):
        super().__init__(crate, relations)
        self.known: tuple[dict, dict] = {}, {}  # at a file's top, and in a function's body
        self.tried = self.filled = self.left = 0
        self.code: dict[str, FunctionType] = {}
        self.forget()

    def forget(self) -> None:
        """Drops what is known of whole texts; what read() has returned before can't be looked up any more."""
        self.wholes: dict[str, Whole | list] = {}  # or its plan, where a list or a struct differs
        self.rows: dict[str, list[dict]] = {n: [] for n in self.wanted}  # all different rows of the wholes
        self.differing: dict[str, set[str]] = {n: set() for n in self.wanted}  # their columns that differ in some whole
        self.columns: dict[str, list] = {}  # the rows' columns, as far as they have been made
        self.places: dict[str, int] = {}
        self.steps: dict[tuple, tuple] = {}
        self.shared: dict[str, dict[str, list[int]]] = {}

    def full(self) -> bool:
        return len(self.wholes) >= WHOLES or len(self.places) >= WHOLES or len(self.steps) >= WHOLES

    def read(self, text: str) -> Facts | tuple[Whole, list[str]]:
        """The facts, or the text's Whole and its runs."""
        if self._seldom() or "\0" in text or text[:1] == "﻿":
            return self.parse(text)
        parts = _RUN.split(text)
        fills, template = parts[1::2], "\0".join(parts[::2])
        whole = self.wholes.get(template)
        if whole is None:
            plan = self._plan(template, fills)
            if plan is None:
                self._tell(False)
                return super().parse(text)
            if len(template) > LONG:
                whole = plan
            else:
                whole = self.wholes[template] = self._whole(template, plan, len(fills)) or plan
        self._tell(True)
        return (whole, fills) if whole.__class__ is Whole else self._run(whole, fills)

    def parse(self, text: str) -> Facts:
        if self._seldom() and self.left < 15:  # one of 16 is tried
            self.left += 1
            return super().parse(text)
        self.left = 0
        found = self._filled(text)
        self._tell(found is not None)
        return super().parse(text) if found is None else found

    def _seldom(self) -> bool:
        """Whether such texts hardly repeat."""
        return self.tried >= 1_024 and self.filled * 8 < self.tried

    def _tell(self, filled: bool) -> None:
        self.tried, self.filled = self.tried + 1, self.filled + filled
        if self.tried >= 4_096:
            self.tried, self.filled = self.tried // 2, self.filled // 2

    def _filled(self, text: str) -> Facts | None:
        """The facts, if all pieces are known."""
        if "\0" in text or text[:1] == "﻿":
            return None
        parts = _RUN.split(text)
        plan = self._plan("\0".join(parts[::2]), parts[1::2])
        return None if plan is None else self._run(plan, parts[1::2])

    def _plan(self, template: str, fills: list[str]) -> list[tuple[FunctionType, int, int, int]] | None:
        """The codes of a whole text, with their runs and lines, if all pieces are known."""
        tops, bodies = self.known
        known, pending, at, line, plan = tops, "", 0, 1, []
        for piece in template.split("\n"):
            if pending:
                piece = pending + piece
            entry = known.get(piece, 0)
            if entry.__class__ is int:
                entry = self._counted(piece, fills[at : at + piece.count("\0")], known, known is bodies)
            if entry is _MORE:
                pending = piece + "\n"
                continue
            if not entry:
                return None
            code, runs, lines, in_body = entry
            if code is not None:
                plan.append((code, at, at + runs, line))
            known, pending, at, line = bodies if in_body else tops, "", at + runs, line + lines
        return None if known is not tops or pending else plan

    def _run(self, plan: list[tuple[FunctionType, int, int, int]], fills: list[str]) -> Facts:
        lists = [], [], [], [], [], [], [], []  # of RELATIONS, the fields of Facts
        fn = public = span = None
        for code, at, end, line in plan:
            fn, public, span = code(fills[at:end], line, fn, public, span, *lists)
        return Facts(*lists)

    def _whole(self, template: str, plan: list[tuple[FunctionType, int, int, int]], runs: int) -> Whole | None:
        """The plan run over marks in place of the runs; None if a list or a struct differs.

        What a code finds in one place is looked at once, unless a later code changes it, as the end of a span.
        """
        if runs > 0xFFF or _MARKS.search(template):
            return None
        marks = [chr(_MARK + i) for i in range(runs)]
        steps, lists = [], [[] for _ in RELATIONS]
        fn = public = span = None
        for step in plan:
            code, at, end, line = step
            key = (*step, fn, public)
            found = self.steps.get(key)
            if found is None:
                code = FunctionType(code.__code__, {"len": lambda mark: _Sum(0, (ord(mark) - _MARK,))})
                fn, public, span = code(marks[at:end], line, fn, public, span, *lists)
                if "fn_spans" in self.rows:
                    continue
                found = self.steps[key] = fn, public, self._looked_at(lists)
                lists = [[] for _ in RELATIONS]
            fn, public, rows = found
            steps.append(rows)
        if "fn_spans" in self.rows:
            steps.append(self._looked_at(lists))
        texts: dict[str, int] = {}
        numbers: dict[str, int] = {}
        places: dict[str, list[int]] = {}
        differ: dict[str, dict[str, list[int]]] = {}
        for rows in steps:
            if rows is None:
                return None
            for name, place, items in rows:
                ids = places.setdefault(name, [])
                for column, item, is_text in items:
                    values = texts if is_text else numbers
                    at = differ.setdefault(name, {}).setdefault(column, [])
                    at += [-1] * (len(ids) - len(at))
                    at.append(values.setdefault(item, len(values)))
                ids.append(place)
        made = {}
        for name, ids in places.items():
            columns = differ.get(name, {})
            for at in columns.values():
                at += [-1] * (len(ids) - len(at))
            made[name] = ids, self.shared.setdefault(repr(columns), columns)
            self.differing[name].update(columns)
        return Whole(made, self._list(texts), self._list(numbers), len(texts), len(numbers))

    def _looked_at(self, lists: list[list[dict]]) -> list[tuple[str, int, list[tuple[str, str, bool]]]] | None:
        """The relation of each row, its place in self.rows, and code for its columns that differ; None if one is a list or a struct."""
        out = []
        for name, rows in zip(RELATIONS, lists):
            for row in rows:
                constant, items = {}, []
                for k, v in row.items():
                    if v.__class__ is str and _MARKS.search(v):
                        parts = [f"f[{ord(p) - _MARK}]" if _MARKS.fullmatch(p) else repr(p) for p in _MARKS.split(v) if p]
                        items.append((k, " + ".join(parts) if len(parts) < 4 else f"''.join(({', '.join(parts)}))", True))
                    elif v.__class__ is _Sum:
                        items.append((k, " + ".join([str(v.number), *(f"len(f[{n}])" for n in v.runs)]), False))
                    elif v.__class__ in (list, dict) and _marked(v):
                        return None
                    else:
                        constant[k] = v
                key = f"{name} {constant!r}"
                if key not in self.places:
                    self.places[key] = len(self.rows[name])
                    self.rows[name].append(constant)
                out.append((name, self.places[key], items))
        return out

    def _list(self, items: dict[str, int]) -> FunctionType | None:
        """Code for a list of what the items give for f; templates mostly share it."""
        source = f"lambda f: [{', '.join(items)}]"
        if items and source not in self.code:
            self.code[source] = eval(source)
        return self.code[source] if items else None

    def _counted(self, piece: str, fills: list[str], known: dict, in_body: bool):
        """The entry of a piece that has none yet, when it has been seen often enough."""
        seen = known.get(piece, 0)
        if not seen and len(known) >= TEMPLATES:
            for p in [p for p, e in known.items() if e.__class__ is int]:
                del known[p]
            if len(known) >= TEMPLATES:
                return None
        if seen < SEEN:
            if len(piece) <= LONG:
                known[piece] = seen + 1
            return None
        try:
            known[piece] = self._entry(piece, fills, in_body)
        except (_Refused, SourceError, RecursionError, IndexError, KeyError):
            known[piece] = False
        return known[piece]

    def _entry(self, piece: str, fills: list[str], in_body: bool):
        """_MORE, or code, the numbers of runs and lines, and whether a body is open at the end."""
        if any("'" in row and "\0" in row for row in piece.split("\n")):
            raise _Refused
        parts, text, runs = piece.split("\0"), "", []
        for constant, fill in zip(parts, [*fills, ""]):
            text += constant
            runs.append((len(text), len(text) + len(fill)))
            text += fill
        runs.pop()
        if not in_body and text.startswith("#!"):
            raise _Refused
        before = "{\n" if in_body else ""
        for after in ("\n}", "") if in_body else ("", "\n}"):
            try:
                src = Source(before + text + after)
            except SourceError:
                continue
            if src.colons:
                raise _Refused
            steps = _steps(src, len(before) // 2, len(src.kinds) - len(after) // 2, in_body)
            if steps is not None:
                return self._written(src, steps, text, runs, len(before)), len(runs), piece.count("\n") + 1, (after != "")
        if len(piece) > LONG:
            raise _Refused
        return _MORE

    def _written(self, src: Source, steps: list[tuple[str, int, int]], text: str, runs: list[tuple[int, int]], shift: int):
        """The steps' code; None if there is nothing to do."""
        code: list[str] = []
        for kind, first, last in steps:

            def shown(i: int, first: int = first) -> list[str | int]:
                """A token as constants and numbers of runs."""
                start = src.starts[first + i] - shift
                end, out = start + len(src.texts[first + i]), []
                for n, (a, b) in enumerate(runs):
                    if b > start and a < end:
                        if a < start or b > end:
                            raise _Refused
                        out += [text[start:a], n]
                        start = b
                return [p for p in [*out, text[start:end]] if p != ""]

            def place(name: str, first: int = first, closed: int = last + 1 if kind == "head" else -1) -> str:
                """A line or a column."""
                if name in ("fn", "public"):
                    return name
                i = first + int(name[1:].rstrip("e"))
                if i == closed:
                    raise _Refused
                at = src.starts[i] - shift + (len(src.texts[i]) if name[-1] == "e" else 0)
                if name[0] == "l":
                    return "line + " + str(text.count("\n", 0, at))
                begin = text.rfind("\n", 0, at) + 1
                inside = [n for n, (a, b) in enumerate(runs) if a >= begin and b <= at]
                return " + ".join([str(at - begin - sum(runs[n][1] - runs[n][0] for n in inside)), *(f"len(f[{n}])" for n in inside)])

            if kind == "close":
                if "fn_spans" in self.wanted:
                    code.append(f"  span['end_line'], span['end_col'] = {place('l0e')}, {place('c0e')}")
                continue
            for i in range(first, last + 1):
                token = src.kinds[i] not in FIXED and "".join("\0" if p.__class__ is int else p for p in shown(i - first))
                if token in _NUMBERED:
                    raise _Refused
            made = self._parsed(kind, src, first, last)
            if made is None:
                raise _Refused
            for n in self.wanted:
                for row in getattr(made.facts, n):
                    if kind == "head" and n == "fn_spans":
                        row = row | {"end_line": None, "end_col": None}
                        code += [f"  span = {_code(row, shown, place)}", "  fn_spans.append(span)"]
                    else:
                        code.append(f"  {n}.append({_code(row, shown, place)})")
            if kind == "head":
                span = made.facts.fn_spans[0]
                code.append(f"  fn, public = {_code(span['fq_name'], shown, place)}, {span['is_public']}")
        if not code:
            return None
        space: dict = {}
        exec("\n".join([f"def piece(f, line, fn, public, span, {', '.join(RELATIONS)}):", *code, "  return fn, public, span"]), space)
        return space["piece"]


def _steps(src: Source, i: int, stop: int, in_body: bool) -> list[tuple[str, int, int]] | None:
    """(kind, first, last) of the tokens from i to stop, cut as by Shapes; None if the last piece isn't whole.

    A bracket before i is an open body's, one after stop ends a body that isn't closed yet.
    """
    kinds, texts, partner = src.kinds, src.texts, src.partner
    close, out = partner[0] if in_body else -1, []
    if (in_body and close > stop) or (in_body and stop < len(kinds) and close != stop):
        return None
    while i < stop:
        at = i
        if in_body and i == close:
            out.append(("close", i, i))
            in_body, i = False, i + 1
        elif in_body:
            while at < close and texts[at] != ";":
                at = partner[at] + 1 if kinds[at] == "open" else at + 1
            if at == close == stop:
                return None
            out.append(("body", i, min(at, close - 1)))
            i = out[-1][2] + 1
        else:
            if kinds[i] == "idoc" or texts[i] == ";" or texts[i : i + 2] == ["#", "!"]:
                raise _Refused
            while at < stop and texts[at] != ";" and texts[at] != "{":
                at = partner[at] + 1 if kinds[at] == "open" else at + 1
            if at >= stop:
                return None
            if texts[at] == "{":
                close = partner[at]
                if any(kinds[k] == "ident" and texts[k] == "fn" for k in range(i, at)) and (close > at + 1 or close == stop):
                    out.append(("head", i, at))
                    in_body, i = True, at + 1
                    continue
                if close >= stop:
                    return None
                at = close + 1 if close + 1 < stop and texts[close + 1] == ";" else close
            out.append(("item", i, at))
            i = at + 1
    return out if in_body == (stop < len(kinds)) else None


def _marked(value) -> bool:
    if isinstance(value, dict):
        return any(map(_marked, value.values()))
    return any(map(_marked, value)) if isinstance(value, list) else isinstance(value, _Sum) or (isinstance(value, str) and _MARKS.search(value) is not None)


def _code(value, shown, place) -> str:
    if isinstance(value, _At):
        return place(value)
    if isinstance(value, str):
        parts: list[str] = []
        runs = []
        for p in _MARKS.split(value):
            runs += shown(ord(p) - _MARK) if _MARKS.fullmatch(p) else [p] if p else []
        for p in runs:
            if p.__class__ is int:
                parts.append(f"f[{p}]")
            elif parts and parts[-1][0] != "f":
                parts[-1] = repr(eval(parts[-1]) + p)
            else:
                parts.append(repr(p))
        return parts[0] if len(parts) == 1 else " + ".join(parts) if 1 < len(parts) < 4 else f"''.join(({', '.join(parts)}))" if parts else "''"
    if isinstance(value, list):
        return f"[{', '.join(_code(v, shown, place) for v in value)}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k!r}: {_code(v, shown, place)}" for k, v in value.items() if not k.startswith("_")) + "}"
    return repr(value)


@cache
def templates_of(crate: str, relations: tuple[str, ...]) -> Templates:
    """One for all tasks of a worker."""
    return Templates(crate, relations)

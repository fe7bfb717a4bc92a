"""Facts of a Rust source file, by recursive descent and without a syntax tree.

Facts are appended as the text is read. Where a fact comes before others in pre-order but is known
only after them (an outer call, a path with generic arguments), it is put in at a mark that was taken
where its text starts.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from .lexer import Source, SourceError, joined

#: Single-segment paths that count as path occurrences.
KEPT_SINGLE = {"std", "core", "alloc", "crate", "self", "super"}
INTERNAL = {"crate", "self", "super"}
ITEM_WORDS = {"fn", "struct", "enum", "union", "trait", "impl", "mod", "use", "const", "static", "type", "extern", "unsafe", "async", "macro_rules", "auto", "safe", "default", "macro"}
BINARY = ["<<=", ">>=", "..=", "...", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<", ">>", "..", "+", "-", "*", "/", "%", "^", "&", "|", "=", "<", ">"]
BINARY_STARTS = {op[0] for op in BINARY}
RESERVED = {"as", "break", "const", "continue", "else", "enum", "extern", "fn", "for", "if", "impl", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref", "return", "static", "struct", "trait", "type", "unsafe", "use", "where", "while", "async", "await", "dyn"}


_MARKS = {"punct", "open", "close"}
_END_KINDS, _END_TEXTS = ["end"] * 64, [""] * 64


@dataclass
class Facts:
    functions: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    macros_def: list[dict] = field(default_factory=list)
    macros_inv: list[dict] = field(default_factory=list)
    paths: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    fn_spans: list[dict] = field(default_factory=list)
    no_std: bool = False


def parse(text: str, crate: str) -> Facts:
    """All facts of one file; SourceError if it doesn't parse."""
    return parse_source(Source(text), crate)


def parse_source(source: Source, crate: str) -> Facts:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    return Parser(source, crate).file()


class _Earlier:
    def __init__(self, facts: Facts):
        self.lists = facts.paths, facts.calls, facts.macros_inv

    def __enter__(self):
        self.marks, self.ends = [len(x) for x in self.lists], []
        return lambda: self.ends.extend(len(x) for x in self.lists)

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            for x, mark, end in zip(self.lists, self.marks, self.ends):
                if end < len(x):
                    x[mark:] = x[end:] + x[mark:end]


class Parser:
    def __init__(self, source: Source, crate: str):
        self.src, self.crate = source, crate
        self.n, self.i, self.glued = len(self.src.kinds), 0, set()
        # kinds, texts, starts, and the characters of punctuation and brackets by token, with room to look ahead
        self.kinds, self.texts, self.starts = self.src.kinds + _END_KINDS, self.src.texts + _END_TEXTS, self.src.starts
        self.marks = [t if k in _MARKS else "" for k, t in zip(self.kinds, self.texts)]
        self.facts = Facts()
        self.mods: list[str] = []
        self.fn: str | None = None
        self.fn_public: bool | None = None
        self.self_ty: str | None = None
        self.trait_ty: str | None = None
        self.trait: str | None = None
        self.in_body = False

    # -- tokens

    def fail(self, wanted: str):
        line = self.src.position(self.starts[self.i])[0] if self.i < self.n else len(self.src.lines)
        raise SourceError(f"expected {wanted}", line)

    def text(self, k: int = 0) -> str:
        return self.texts[self.i + k]

    def kind(self, k: int = 0) -> str:
        return self.kinds[self.i + k]

    def at_word(self, *words: str) -> bool:
        return self.texts[self.i] in words and self.kinds[self.i] == "ident"

    def word(self, word: str) -> bool:
        if self.texts[self.i] == word and self.kinds[self.i] == "ident":
            self.i += 1
            return True
        return False

    def at(self, op: str, k: int = 0) -> bool:
        """Whether the next tokens are the characters of op without space between them."""
        j = self.i + k
        if self.marks[j] != op[0]:
            return False
        for n in range(1, len(op)):
            if self.marks[j + n] != op[n] or self.starts[j + n - 1] + 1 != self.starts[j + n]:
                return False
        return True

    def eat(self, op: str) -> bool:
        if self.marks[self.i] != op[0]:
            return False
        if len(op) > 1:
            if not self.at(op):
                return False
            self.glued.update(range(self.i, self.i + len(op) - 1))
        self.i += len(op)
        return True

    def need(self, op: str) -> None:
        if not self.eat(op):
            self.fail(op)

    def ident(self) -> str:
        if self.kind() != "ident":
            self.fail("a name")
        self.i += 1
        return self.texts[self.i - 1]

    def place(self, i: int, end: bool = False) -> tuple[int, int]:
        """Line and column of a token's start or end."""
        return self.src.position(self.starts[i] + (len(self.texts[i]) if end else 0))

    def where_at(self, first: int) -> dict:
        line, column = self.place(min(first, self.n - 1))
        return {"line": line, "column": column}

    def shown(self, first: int, stop: int | None = None) -> str:
        return joined(self.kinds, self.texts, self.glued, first, self.i if stop is None else stop)

    def closing(self) -> int:
        return self.src.partner[self.i]

    # -- facts

    def occurrence(self, first: int, **more) -> dict:
        line, column = self.place(min(first, self.n - 1))
        more.update(module_path=list(self.mods), enclosing_fn=self.fn, enclosing_public=self.fn_public, line=line, column=column)
        return more

    def earlier(self) -> _Earlier:
        """Moves the facts of the block to a mark: gives a function that sets the mark."""
        return _Earlier(self.facts)

    def fq_name(self, name: str, owner: str | None) -> str:
        return "::".join([self.crate, *self.mods, *([owner] if owner is not None else []), name])

    # -- file and items

    def file(self) -> Facts:
        while self.at("#!") and self.text(2) == "[" or self.kind() == "idoc":
            if self.kind() == "idoc":
                self.i += 1
            else:
                self.i += 2
                self.facts.no_std |= self.attribute() == "no_std"
        self.items(self.n)
        return self.facts

    def items(self, stop: int) -> None:
        while self.i < stop:
            if self.kind() == "idoc":
                self.i += 1
            else:
                self.item()

    def attribute(self) -> str:
        """From the [ of an attribute; its path."""
        close = self.closing()
        self.i += 1
        if self.at_word("unsafe") and self.text(1) == "(":
            self.i += 2
        path = self.path("mod")
        self.i = close + 1
        return path

    def attributes(self) -> list[str]:
        """Outer and inner attributes at this place; their paths."""
        out = []
        if self.marks[self.i] != "#" and self.kinds[self.i] not in ("doc", "idoc"):
            return out
        while True:
            if self.kind() in ("doc", "idoc"):
                self.i += 1
                out.append("doc")
            elif self.at("#") and self.text(1) == "[":
                self.i += 1
                out.append(self.attribute())
            elif self.at("#!") and self.text(2) == "[":
                self.i += 2
                self.attribute()
            else:
                return out

    def visibility(self) -> bool:
        """Whether the item is plainly public."""
        if self.at_word("crate") and not self.at("::", 1):
            self.i += 1
            return False
        if not self.word("pub"):
            return False
        if self.text() == "(" and self.kind() == "open":
            close = self.closing()
            if self.text(1) in INTERNAL and self.i + 2 == close or self.text(1) == "in":
                self.i += 1
                self.word("in")
                self.path("mod")
                self.i = close + 1
                return False
        return True

    def item(self) -> None:
        first = self.i
        before = len(self.facts.paths)
        attrs = self.attributes()
        start = self.i
        public = self.visibility()
        self.word("default") if self.text(1) not in ("!", "::") and self.at_word("default") and self.kind(1) == "ident" else None
        if self.starts_fn():
            # the function is the context of its own attributes and visibility
            heads, self.facts.paths[before:] = self.facts.paths[before:], []
            self.function(first, start, attrs, public, heads)
        elif self.at_word("use"):
            self.use_item(public)
        elif self.at_word("mod") or self.at_word("unsafe") and self.text(1) == "mod":
            del self.facts.paths[before:]
            self.word("unsafe")
            self.module()
        elif self.at_word("impl") or self.at_word("unsafe") and self.text(1) == "impl":
            self.impl_item()
        elif self.at_word("trait") or self.at_word("unsafe", "auto") and (self.text(1) == "trait" or self.text(2) == "trait"):
            self.trait_item()
        elif self.at_word("struct") or self.at_word("union") and self.kind(1) == "ident":
            self.struct_item()
        elif self.at_word("enum"):
            self.enum_item()
        elif self.at_word("const", "static") and not (self.text(1) == "{"):
            self.value_item()
        elif self.at_word("type"):
            self.type_item()
        elif self.at_word("extern") or self.at_word("unsafe") and self.text(1) == "extern":
            self.extern_item()
        elif self.at_word("macro") and self.kind(1) == "ident":
            del self.facts.paths[before:]
            self.macro_item()
        elif self.kind() == "ident" or self.at("::"):
            self.item_macro(first)
        else:
            self.fail("an item")

    def starts_fn(self) -> bool:
        k = 0
        while self.kind(k) == "ident" and self.text(k) in ("const", "async", "unsafe", "safe", "extern", "default"):
            if self.text(k) == "extern" and self.kind(k + 1) == "lit":
                k += 1
            k += 1
        return self.kind(k) == "ident" and self.text(k) == "fn"

    def function(self, first: int, start: int, attrs: list[str], public: bool, heads: list[dict], member: bool = False) -> None:
        name_at = next(k for k in range(self.i, self.n) if self.texts[k] == "fn" and self.kinds[k] == "ident") + 1
        name = self.texts[name_at]
        if member and self.self_ty is not None and self.member_of == "impl":
            kind, owner, shown = {"kind": "ImplMethod", "self_ty": self.self_ty, "trait_ty": self.trait_ty, "trait_name": None}, self.self_ty, public
        elif self.trait is not None:
            kind, owner, shown = {"kind": "TraitMethod", "self_ty": None, "trait_ty": None, "trait_name": self.trait}, self.trait, True
        else:
            kind, owner, shown = {"kind": "FreeFn", "self_ty": None, "trait_ty": None, "trait_name": None}, None, public
        fq = self.fq_name(name, owner)
        held = self.fn, self.fn_public, self.in_body
        self.fn, self.fn_public = fq, shown
        self.facts.paths += [p | {"enclosing_fn": fq, "enclosing_public": shown} for p in heads]
        slot, wanted = len(self.facts.functions), not self.in_body
        span = {"fq_name": fq, "is_public": shown, "kind": kind}
        self.facts.fn_spans.append(span)
        sig = self.signature()
        if wanted:
            self.facts.functions.insert(slot, {"name": name, "fq_name": fq, "is_public": shown, "has_docs": "doc" in attrs, **sig, "kind": kind, "module_path": list(self.mods), "attrs": attrs, **self.where_at(first)})
        if not self.eat(";"):
            if self.text() != "{":
                self.fail("a body")
            self.in_body = True
            self.block()
        (sl, sc), (el, ec) = self.place(first), self.place(self.i - 1, end=True)
        span.update(start_line=sl, start_col=sc, end_line=el, end_col=ec)
        self.fn, self.fn_public, self.in_body = held

    member_of = ""

    def signature(self) -> dict:
        first = self.i
        flags = set()
        while not self.word("fn"):
            flags.add(self.ident())
            if self.kind() == "lit":
                self.i += 1
        self.ident()
        with self.earlier() as set_mark:
            # the where clause is read last but belongs to the generics
            generic = self.generics()
            with self.earlier() as set_inner:
                if self.text() != "(":
                    self.fail("(")
                close, args = self.closing(), []
                self.i += 1
                while self.i < close:
                    arg = self.i
                    self.attributes()
                    if self.at("..."):
                        self.eat("...")
                    elif not self.receiver():
                        mark = self.i
                        self.pattern()
                        if self.eat(":"):
                            if not self.eat("..."):
                                self.type()
                        else:
                            self.i = mark
                            self.type()
                    variadic = self.i - arg >= 3 and self.texts[self.i - 1] == "." and self.i - 1 not in self.glued
                    if not variadic:
                        args.append(self.shown(arg))
                    if not self.eat(","):
                        break
                if self.i != close:
                    self.fail("an argument")
                self.i += 1
                result = None
                if self.eat("->"):
                    mark = self.i
                    self.type()
                    result = self.shown(mark)
                stop = self.i
                set_inner()
                self.where_clause()
                stop = self.i
            set_mark()
        return {
            "is_async": "async" in flags, "is_unsafe": "unsafe" in flags, "is_const": "const" in flags, "is_generic": generic,
            "args": args, "return_ty": result, "signature": self.shown(first, stop),
        }

    def receiver(self) -> bool:
        k = 0
        if self.at("&"):
            k = 1
            if self.kind(k) == "life":
                k += 1
        if self.kind(k) == "ident" and self.text(k) == "mut":
            k += 1
        if self.kind(k) == "ident" and self.text(k) == "self" and not self.at("::", k + 1):
            self.i += k + 1
            if self.eat(":"):
                self.type()
            return True
        return False

    def generics(self) -> bool:
        """Parameters in <>; whether there are any."""
        if not self.eat("<"):
            return False
        some = False
        while not self.at(">"):
            self.attributes()
            some = True
            if self.kind() == "life":
                self.i += 1
                if self.eat(":"):
                    self.bounds()
            elif self.word("const"):
                self.ident()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.generic_value()
            else:
                self.ident()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")
        return some

    def generic_value(self) -> None:
        if self.text() == "{":
            self.block()
        elif self.kind() == "lit" or self.at("-"):
            self.eat("-")
            self.i += 1
        else:
            self.type()

    def where_clause(self) -> None:
        if not self.word("where"):
            return
        while self.i < self.n and self.text() not in ("{", ";") and not self.at("="):
            if self.kind() == "life":
                self.i += 1
            else:
                self.for_lifetimes()
                self.type()
            self.need(":")
            if self.text() not in (",", "{", ";"):
                self.bounds()
            if not self.eat(","):
                break

    def for_lifetimes(self) -> None:
        if self.at_word("for") and self.text(1) == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.kind() == "life":
                self.i += 1
            elif self.text() == "(" and self.kind() == "open":
                self.i += 1
                self.bound()
                self.need(")")
            elif self.at_word("use") and self.text(1) == "<":
                self.i += 1
                self.need("<")
                while not self.eat(">"):
                    self.i += 1
            elif self.at("?") or self.at("~") or self.kind() == "ident" or self.at("::") or self.at("<"):
                if self.text() in ("where",):
                    return
                self.bound()
            else:
                return
            if not self.at("+") or self.at("+="):
                return
            self.eat("+")

    def bound(self) -> None:
        self.for_lifetimes()
        if self.eat("~"):
            self.ident()
        if self.at_word("const", "async"):
            self.i += 1
        self.eat("?")
        self.for_lifetimes()
        self.path("type")

    def module(self) -> None:
        self.need_word("mod")
        name = self.ident()
        if self.eat(";"):
            return
        close = self.closing() if self.text() == "{" else self.fail("{")
        self.i += 1
        held = len(self.facts.paths)
        while self.kind() == "idoc" or self.at("#!") and self.text(2) == "[":
            self.attributes()
            del self.facts.paths[held:]
        self.mods.append(name)
        self.items(close)
        self.mods.pop()
        self.i = close + 1

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)

    def impl_item(self) -> None:
        self.word("unsafe")
        self.need_word("impl")
        held = self.self_ty, self.trait_ty, self.member_of
        with self.earlier() as set_mark:
            if self.at("<") and (self.text(1) in (">", "#") or self.kind(1) == "life" or self.text(1) == "const" or self.kind(1) == "ident" and self.text(2) in (":", ",", ">", "=") and not self.at("::", 2)):
                self.generics()
            with self.earlier() as set_inner:
                self.word("const")
                self.eat("!")
                mark = self.i
                self.type()
                trait = None
                if self.word("for"):
                    trait = self.last_path
                    mark = self.i
                    self.type()
                self.trait_ty = trait
                self.self_ty = self.last_path.split("::")[-1] if self.type_is_path else self.shown(mark)
                set_inner()
                self.where_clause()
            set_mark()
        self.members("impl")
        self.self_ty, self.trait_ty, self.member_of = held

    last_path, type_is_path = "", False

    def trait_item(self) -> None:
        while self.at_word("unsafe", "auto"):
            self.i += 1
        self.need_word("trait")
        held, member_of = self.trait, self.member_of
        self.trait = self.ident()
        with self.earlier() as set_mark:
            self.generics()
            with self.earlier() as set_inner:
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.bounds()
                set_inner()
                self.where_clause()
            set_mark()
        if not self.eat(";"):
            self.members("trait")
        self.trait, self.member_of = held, member_of

    def members(self, of: str) -> None:
        if self.text() != "{":
            self.fail("{")
        close = self.closing()
        self.i += 1
        while self.i < close:
            self.member_of = of
            first, before = self.i, len(self.facts.paths)
            attrs = self.attributes()
            if self.i == close:
                break
            start = self.i
            public = self.visibility()
            if self.at_word("default") and self.kind(1) == "ident":
                self.i += 1
            if self.starts_fn():
                heads, self.facts.paths[before:] = self.facts.paths[before:], []
                self.function(first, start, attrs, public, heads, member=True)
            elif self.at_word("const"):
                self.value_item()
            elif self.at_word("type"):
                self.type_item()
            else:
                self.path("mod")
                self.need("!")
                self.macro_body()
                self.eat(";")
        self.i = close + 1

    def struct_item(self) -> None:
        self.i += 1
        self.ident()
        self.generics()
        self.where_clause()
        self.fields()
        self.where_clause()
        self.eat(";")

    def fields(self) -> None:
        if self.kind() != "open":
            return
        named, close = self.text() == "{", self.closing()
        self.i += 1
        while self.i < close:
            self.attributes()
            if self.i == close:
                break
            self.visibility()
            if named:
                self.word("unsafe") if self.kind(1) == "ident" else None
                self.ident()
                self.need(":")
            self.type()
            if self.eat("="):
                self.expr()
            if not self.eat(","):
                break
        if self.i != close:
            self.fail("a field")
        self.i += 1

    def enum_item(self) -> None:
        self.i += 1
        self.ident()
        self.generics()
        self.where_clause()
        if self.text() != "{":
            self.fail("{")
        close = self.closing()
        self.i += 1
        while self.i < close:
            self.attributes()
            if self.i == close:
                break
            self.visibility()
            self.ident()
            self.fields()
            if self.eat("="):
                self.expr()
            if not self.eat(","):
                break
        if self.i != close:
            self.fail("a variant")
        self.i += 1

    def value_item(self) -> None:
        self.i += 1
        self.word("mut")
        self.ident()
        self.generics()
        if self.eat(":"):
            self.type()
        if self.eat("="):
            self.expr()
        self.where_clause()
        self.need(";")

    def type_item(self) -> None:
        self.need_word("type")
        self.ident()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where_clause()
        if self.eat("="):
            self.type()
        self.where_clause()
        self.need(";")

    def extern_item(self) -> None:
        self.word("unsafe")
        self.need_word("extern")
        if self.word("crate"):
            self.ident()
            if self.word("as"):
                self.ident()
            self.need(";")
            return
        if self.kind() == "lit":
            self.i += 1
        if self.text() != "{":
            self.fail("{")
        close = self.closing()
        self.i += 1
        while self.i < close:
            first = self.i
            self.attributes()
            if self.i == close:
                break
            self.visibility()
            if self.starts_fn():
                self.signature()
                self.need(";")
            elif self.at_word("static") or self.at_word("safe", "unsafe") and self.text(1) == "static":
                self.word("safe") or self.word("unsafe")
                self.value_item()
            elif self.at_word("type"):
                self.type_item()
            else:
                self.i = first
                self.attributes()
                self.path("mod")
                self.need("!")
                self.macro_body()
                self.eat(";")
        self.i = close + 1

    def use_item(self, public: bool) -> None:
        self.need_word("use")
        absolute = self.eat("::")
        self.use_tree([], public, absolute)
        self.need(";")

    def use_tree(self, prefix: list[str], public: bool, absolute: bool) -> None:
        if self.text() == "{" and self.kind() == "open":
            close = self.closing()
            self.i += 1
            while self.i < close:
                self.eat("::")
                self.use_tree(prefix, public, absolute)
                if not self.eat(","):
                    break
            if self.i != close:
                self.fail("a use tree")
            self.i += 1
            return
        first = self.i
        if self.eat("*"):
            self.use_leaf(first, [*prefix, "*"], "Glob", None, "*", public, absolute)
            return
        name = self.ident()
        if self.eat("::"):
            self.use_tree([*prefix, name], public, absolute)
        elif self.word("as"):
            alias = "_" if self.eat("_") else self.ident()
            self.use_leaf(first, [*prefix, name], "Rename", alias, alias, public, absolute)
        else:
            self.use_leaf(first, [*prefix, name], "Name", None, name, public, absolute)

    def use_leaf(self, first: int, segments: list[str], kind: str, alias: str | None, shown: str, public: bool, absolute: bool) -> None:
        if self.in_body:
            return
        where = self.where_at(first)
        if public:
            self.facts.exports.append({"exported_as": shown, "source_path": "::".join(segments), "module_path": list(self.mods), **where})
        self_name = kind == "Name" and segments[-1] == "self"
        kept = segments[:-1] if self_name else segments
        raw = {"raw_segments": segments, "self_name": self_name}
        if not kept:
            # a bare `use self` names nothing here; the earlier variant still lists it
            self.facts.imports.append({"root": "self", "segments": [], "module_path": list(self.mods), "is_internal": True, "is_public_use": public, "kind": {"kind": kind, "alias": alias}, "full_path": "self", "is_absolute": absolute, "listed": False, **raw, **where})
            return
        full = ("::" if absolute else "") + "::".join(kept)
        self.facts.imports.append(
            {
                "root": kept[0], "segments": kept[1:], "module_path": list(self.mods), "is_internal": kept[0] in INTERNAL, "is_public_use": public,
                "kind": {"kind": kind, "alias": alias}, "full_path": full, "is_absolute": absolute, "listed": True, **raw, **where,
            }
        )

    def item_macro(self, first: int) -> None:
        path = self.path("mod")
        self.need("!")
        name = self.ident() if self.kind() == "ident" else None
        if path == "macro_rules":
            self.facts.macros_def.append({"name": name or "<macro>", "module_path": list(self.mods), **self.where_at(first)})
        else:
            self.facts.macros_inv.append(self.occurrence(first, name=path.split("::")[-1], path=path, position="item"))
        brace = self.text() == "{"
        self.macro_body()
        if not brace:
            self.need(";")
        else:
            self.eat(";")

    def macro_item(self) -> None:
        """A declarative macro: `macro name { … }` or `macro name(…) { … }`. It's opaque and gives no facts."""
        self.word("macro")
        self.ident()
        if self.text() == "(" and self.kind() == "open":
            self.macro_body()
        if self.text() != "{":
            self.fail("{")
        self.macro_body()

    def macro_body(self) -> None:
        """A delimited token tree; inside, operators keep the spacing of the text."""
        if self.kind() != "open":
            self.fail("macro arguments")
        close = self.closing()
        for k in range(self.i + 1, close):
            if self.kinds[k] == "punct" and self.kinds[k + 1] == "punct" and self.starts[k] + 1 == self.starts[k + 1]:
                self.glued.add(k)
        self.i = close + 1

    # -- paths and types

    def path(self, style: str) -> str:
        """One path. style: mod (no arguments), type (Vec<T>, Fn(A) -> B) or expr (arguments after ::)."""
        first, mark = self.i, len(self.facts.paths)
        self.eat("::")
        names = [self.segment(style)]
        while self.at("::") and not (style == "mod" and self.text(2) in ("{", "*")):
            if style == "expr" and self.text(2) == "<":
                break
            self.eat("::")
            names.append(self.segment(style))
        return self.path_fact(first, mark, names)

    def path_fact(self, first: int, mark: int, names: list[str]) -> str:
        path = "::".join(names)
        if not names:
            return path
        self.facts.paths.insert(mark, self.occurrence(first, path=path, keep=len(names) > 1 or path in KEPT_SINGLE))
        return path

    def segment(self, style: str) -> str:
        name = self.ident()
        if style == "type":
            if self.at("::") and self.text(2) in ("<", "("):
                self.eat("::")
            if self.at("<") and not self.at("<="):
                self.generic_arguments()
            elif self.text() == "(" and self.kind() == "open":
                close = self.closing()
                self.i += 1
                while self.i < close:
                    self.type()
                    if not self.eat(","):
                        break
                if self.i != close:
                    self.fail("a type")
                self.i += 1
                if self.eat("->"):
                    self.type(bounds=False)
        elif style == "expr" and self.at("::") and self.text(2) == "<":
            self.eat("::")
            self.generic_arguments()
        return name

    def generic_arguments(self) -> None:
        self.need("<")
        while not self.at(">"):
            if self.kind() == "life":
                self.i += 1
            elif self.kind() == "lit" or self.at("-") or self.text() == "{":
                self.generic_value()
            elif self.kind() == "ident" and self.text(1) in ("=", ":") and not self.at("::", 1) and not self.at("==", 1):
                self.i += 1
                if self.eat("="):
                    self.generic_value()
                else:
                    self.need(":")
                    self.bounds()
            else:
                self.type()
                if self.eat("="):  # an associated type with arguments of its own
                    self.type()
                elif self.at(":") and not self.at("::"):
                    self.eat(":")
                    self.bounds()
            if not self.eat(","):
                break
        self.need(">")

    def qualified(self, style: str) -> list[str]:
        """<T as Trait>::name: the type, then one path of the trait's and the following segments."""
        first = self.i
        self.need("<")
        self.type()
        mark, names = len(self.facts.paths), []
        if self.word("as"):
            self.eat("::")
            names.append(self.segment("type"))
            while self.eat("::"):
                names.append(self.segment("type"))
        self.need(">")
        while self.at("::") and not (style == "expr" and self.text(2) == "<"):
            self.eat("::")
            names.append(self.segment(style))
        self.path_fact(first, mark, names)
        return names

    def type(self, bounds: bool = True) -> None:
        self.type_is_path = False
        text, kind = self.text(), self.kind()
        if kind == "open" and text in "([":
            close = self.closing()
            self.i += 1
            while self.i < close:
                self.type()
                if text == "[" and self.eat(";"):
                    self.expr()
                if not self.eat(","):
                    break
            if self.i != close:
                self.fail("a type")
            self.i += 1
            self.type_is_path = False
        elif self.eat("!") or self.eat("_") or kind == "ident" and text == "_" and self.word("_"):
            pass
        elif self.eat("&"):
            if self.kind() == "life":
                self.i += 1
            self.word("mut")
            self.type(bounds=False)
            self.type_is_path = False
        elif self.eat("*"):
            self.word("mut") or self.need_word("const")
            self.type(bounds=False)
            self.type_is_path = False
        elif self.at_word("impl") or self.at_word("dyn") and not self.at("::", 1) and self.text(1) not in (",", ">", ")", ";"):
            self.i += 1
            self.bounds() if bounds else self.one_bound()
            self.type_is_path = False
        elif self.at_word("for") or self.at_word("fn", "unsafe", "extern"):
            self.for_lifetimes()
            if self.starts_fn():
                self.fn_pointer()
            else:
                self.bounds()
            self.type_is_path = False
        elif self.at("<"):
            self.last_path = "::".join(self.qualified("type"))
            self.type_is_path = True
        elif kind == "ident" or self.at("::"):
            self.last_path = own = self.path("type")
            if self.at("!") and self.kind(1) == "open":
                self.eat("!")
                self.macro_body()
                self.type_is_path = False
                return
            if bounds and self.at("+") and not self.at("+="):
                while self.eat("+"):
                    if self.kind() == "life":
                        self.i += 1
                    else:
                        self.bound()
                self.type_is_path = False
                return
            self.last_path, self.type_is_path = own, True
        else:
            self.fail("a type")

    def one_bound(self) -> None:
        if self.kind() == "life":
            self.i += 1
        elif self.text() == "(":
            self.i += 1
            self.bounds()
            self.need(")")
        else:
            self.bound()

    def fn_pointer(self) -> None:
        while not self.word("fn"):
            self.ident()
            if self.kind() == "lit":
                self.i += 1
        if self.text() != "(":
            self.fail("(")
        close = self.closing()
        self.i += 1
        while self.i < close:
            self.attributes()
            if self.eat("..."):
                break
            if (self.kind() == "ident" or self.at("_")) and self.text(1) == ":" and not self.at("::", 1):
                self.i += 2
            self.type()
            if not self.eat(","):
                break
        if self.i != close:
            self.fail("a type")
        self.i += 1
        if self.eat("->"):
            self.type(bounds=False)

    # -- patterns

    def pattern(self) -> None:
        self.eat("|") if not self.at("||") else self.eat("||")
        self.one_pattern()
        while self.at("|") and not self.at("||") and not self.at("|="):
            self.eat("|")
            self.one_pattern()

    def one_pattern(self) -> None:
        text, kind = self.text(), self.kind()
        if kind == "open" and text in "([":
            close = self.closing()
            self.i += 1
            while self.i < close:
                self.attributes()
                self.pattern()
                if not self.eat(","):
                    break
            if self.i != close:
                self.fail("a pattern")
            self.i += 1
        elif self.eat("&"):
            self.word("mut")
            self.one_pattern()
        elif self.at("..") and not self.at("..="):
            self.eat("...") or self.eat("..")
            if self.kind() in ("lit",) or self.kind() == "ident" and self.text() not in ("if",):
                self.range_end()
        elif self.eat("..="):
            self.range_end()
        elif self.eat("_") or kind == "ident" and text == "_" and self.word("_"):
            pass
        elif kind == "lit" or self.at("-"):
            self.eat("-")
            self.i += 1
            self.pattern_range()
        elif self.at_word("box"):
            self.i += 1
            self.one_pattern()
        elif self.at_word("const") and self.text(1) == "{":
            self.i += 1
            self.block()
        elif self.at_word("ref", "mut"):
            self.word("ref")
            self.word("mut")
            self.ident()
            if self.eat("@"):
                self.one_pattern()
        elif self.at("<"):
            self.qualified("expr")
            self.pattern_rest()
        elif kind == "ident" or self.at("::"):
            plain = kind == "ident" and text not in ("crate", "self", "super", "Self") and not self.at("::", 1) and self.text(1) not in ("(", "{", "!") and not self.at("..", 1)
            if plain and text not in RESERVED:
                self.i += 1
                if self.eat("@"):
                    self.one_pattern()
            else:
                self.path("expr")
                if self.at("!") and self.kind(1) == "open":
                    self.eat("!")
                    self.macro_body()
                else:
                    self.pattern_rest()
        else:
            self.fail("a pattern")

    def pattern_range(self) -> None:
        if self.eat("..=") or self.eat("...") or self.eat(".."):
            if self.kind() in ("lit", "ident") and self.text() not in ("if", "in") or self.at("-"):
                self.range_end()

    def range_end(self) -> None:
        self.eat("-")
        if self.kind() == "lit":
            self.i += 1
        elif self.at("<"):
            self.qualified("expr")
        else:
            self.path("expr")

    def pattern_rest(self) -> None:
        text = self.text()
        if self.kind() == "open" and text == "(":
            self.one_pattern()
        elif self.kind() == "open" and text == "{":
            close = self.closing()
            self.i += 1
            while self.i < close:
                self.attributes()
                if self.eat(".."):
                    break
                k = 0
                while self.text(k) in ("ref", "mut", "box"):
                    k += 1
                if k == 0 and self.text(1) == ":" and not self.at("::", 1):
                    self.i += 2
                    self.pattern()
                else:
                    self.one_pattern()
                if not self.eat(","):
                    break
            if self.i != close:
                self.fail("a field pattern")
            self.i += 1
        else:
            self.pattern_range()

    # -- statements and expressions

    def block(self) -> None:
        if self.text() != "{" or self.kind() != "open":
            self.fail("{")
        close = self.closing()
        self.i += 1
        held, self.in_body = self.in_body, True
        while self.i < close:
            self.statement(close)
        self.in_body = held
        self.i = close + 1

    def statement(self, close: int) -> None:
        if self.eat(";"):
            return
        first, before = self.i, len(self.facts.paths)
        self.attributes()
        if self.i == close:
            return
        if self.at_word("let"):
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
                if self.word("else"):
                    self.block()
            self.need(";")
            return
        if self.starts_item():
            del self.facts.paths[before:]
            self.i = first
            self.item()
            return
        # a macro at the start of a statement: its own kind if it ends there
        marks = len(self.facts.macros_inv)
        block_like = self.at_block_like()
        start = self.i
        self.expr(statement=True)
        last = self.i
        ended = self.eat(";")
        if len(self.facts.macros_inv) > marks:
            own = self.facts.macros_inv[marks]
            if own.get("_end") == last and own.get("_start") == start and (ended or self.texts[last - 1] == "}"):
                own["position"] = "stmt"
        if not ended and self.i < close and not block_like and self.texts[last - 1] != "}":
            self.fail(";")

    def starts_item(self) -> bool:
        if self.kind() != "ident":
            return False
        text, nxt = self.text(), self.text(1)
        if text in ("pub", "struct", "enum", "trait", "mod", "use", "static", "type", "impl", "fn"):
            if text == "static":
                return nxt not in ("|", "||", "move")
            return True
        if text == "const":
            return nxt not in ("{", "|", "move", "async") or self.starts_fn()
        if text == "union":
            return self.kind(1) == "ident" and self.text(2) in ("{", "<", "where")
        if text == "extern":
            return True
        if text == "unsafe":
            return nxt in ("fn", "impl", "trait", "extern", "mod") or self.starts_fn()
        if text == "async":
            return self.starts_fn()
        if text == "auto":
            return nxt == "trait"
        return text == "macro_rules" and self.text(1) == "!" and self.kind(2) == "ident"

    def at_block_like(self) -> bool:
        k = 2 if self.kind() == "life" and self.text(1) == ":" else 0
        return self.text(k) == "{" and self.kind(k) == "open" or self.kind(k) == "ident" and self.text(k) in ("if", "match", "while", "loop", "for", "unsafe") or self.text(k) in ("async", "const", "try") and self.text(k + 1) in ("{", "move")

    def expr(self, struct: bool = True, statement: bool = False) -> None:
        """Operands with binary operators between them; their precedence doesn't matter here."""
        self.attributes()
        if statement and self.at_block_like():
            mark = len(self.facts.calls)
            first = self.i
            self.primary(struct)
            if not (self.at(".") and not self.at("..") or self.at("?")):
                return
            self.postfix(first, mark, struct)
        else:
            self.operand(struct)
        while True:
            if self.word("as"):
                self.type(bounds=False)
                continue
            op = next((o for o in BINARY if self.at(o)), None) if self.marks[self.i] in BINARY_STARTS else None
            if op is None or self.at("=>"):
                return
            self.eat(op)
            if op in ("..", "..=", "..."):
                if not self.can_start(struct):
                    continue
            self.operand(struct)

    def can_start(self, struct: bool) -> bool:
        kind, text = self.kind(), self.text()
        if kind in ("end", "close"):
            return False
        if kind == "open":
            return text != "{" or struct
        if kind == "ident":
            return text not in ("as", "else", "in", "where")
        if kind == "punct":
            return text in "-!*&|<#" and not self.at("=>") or self.at("::") or self.at("..")
        return True

    def operand(self, struct: bool) -> None:
        while self.marks[self.i] or self.kinds[self.i] in ("doc", "idoc"):
            self.attributes()
            if self.eat("&"):
                if self.at_word("raw") and self.text(1) in ("const", "mut"):
                    self.i += 2
                else:
                    self.word("mut")
            elif not (self.eat("!") or self.eat("*") or self.eat("-")):
                break
        if self.at(".."):
            self.eat("..=") or self.eat("..")
            if self.can_start(struct):
                self.operand(struct)
            return
        first, mark = self.i, len(self.facts.calls)
        self.primary(struct)
        self.postfix(first, mark, struct)

    def postfix(self, first: int, mark: int, struct: bool) -> None:
        while True:
            if not self.marks[self.i]:
                return
            if self.eat("?"):
                continue
            if self.at(".") and not self.at(".."):
                self.eat(".")
                if self.kind() == "lit":  # 0, or 0.1 for two fields
                    self.i += 1
                    continue
                name = self.ident()
                turbofish = False
                if self.at("::"):
                    self.eat("::")
                    self.generic_arguments()
                    turbofish = True
                if self.text() == "(" and self.kind() == "open":
                    self.facts.calls.insert(mark, self.occurrence(first, callee=name, callee_path=name))
                    self.arguments()
                elif turbofish:
                    self.fail("(")
                continue
            if self.kind() == "open" and self.text() == "(":
                callee = self.shown(first)
                self.facts.calls.insert(mark, self.occurrence(first, callee=callee, callee_path=callee.replace(" :: ", "::")))
                self.arguments()
                continue
            if self.kind() == "open" and self.text() == "[":
                self.arguments()
                continue
            return

    def arguments(self) -> None:
        close = self.closing()
        self.i += 1
        while self.i < close:
            self.expr()
            if not self.eat(",") and not self.eat(";"):
                break
        if self.i != close:
            self.fail("an expression")
        self.i += 1

    def primary(self, struct: bool) -> None:
        kind, text = self.kind(), self.text()
        if kind == "lit":
            self.i += 1
        elif kind == "life":
            self.i += 1
            self.need(":")
            self.primary(struct)
        elif kind == "open":
            if text == "{":
                self.block()
            else:
                self.arguments()
        elif self.at("|"):
            self.closure()
        elif self.at("<"):
            self.qualified("expr")
            self.after_path(self.i, struct)
        elif kind == "ident":
            self.word_primary(text, struct)
        elif self.at("::"):
            self.path_primary(struct)
        elif self.at("#"):
            self.attributes()
            self.primary(struct)
        else:
            self.fail("an expression")

    def word_primary(self, text: str, struct: bool) -> None:
        nxt = self.text(1)
        if text == "if":
            self.i += 1
            self.expr(struct=False)
            self.block()
            if self.word("else"):
                if self.at_word("if"):
                    self.word_primary("if", struct)
                else:
                    self.block()
        elif text == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            self.operand(False)
        elif text == "match":
            self.i += 1
            self.expr(struct=False)
            if self.text() != "{":
                self.fail("{")
            close = self.closing()
            self.i += 1
            while self.i < close:
                self.attributes()
                if self.i == close:
                    break
                self.pattern()
                if self.word("if"):
                    self.expr()
                self.need("=>")
                block = self.text() == "{" and self.kind() == "open"
                self.expr(statement=True)
                if not self.eat(",") and self.i < close and not block and self.texts[self.i - 1] != "}":
                    self.fail(",")
            self.i = close + 1
        elif text == "while":
            self.i += 1
            self.expr(struct=False)
            self.block()
        elif text == "loop":
            self.i += 1
            self.block()
        elif text == "for" and nxt != "<":
            self.i += 1
            self.pattern()
            self.need_word("in")
            self.expr(struct=False)
            self.block()
        elif text == "for":
            self.for_lifetimes()
            self.closure()
        elif text in ("unsafe", "const", "try") and nxt == "{":
            self.i += 1
            self.block()
        elif text in ("async", "gen") and (nxt == "{" or nxt == "move" and self.text(2) == "{"):
            self.i += 1
            self.word("move")
            self.block()
        elif text in ("move", "async", "static", "const") and (nxt in ("|", "move", "async", "static") or text == "move"):
            self.closure()
        elif text in ("return", "break", "continue", "yield", "become"):
            self.i += 1
            if self.kind() == "life":
                self.i += 1
            if text != "continue" and self.can_start(struct):
                self.expr(struct)
        elif text == "_":
            self.i += 1
        else:
            if text in RESERVED:
                self.fail("an expression")
            self.path_primary(struct)

    def closure(self) -> None:
        while self.at_word("move", "async", "static", "const"):
            self.i += 1
        if not self.eat("||"):
            self.need("|")
            while not self.at("|"):
                self.attributes()
                self.one_pattern()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    break
            self.need("|")
        if self.eat("->"):
            self.type(bounds=False)
            self.block()
        else:
            self.expr()

    def path_primary(self, struct: bool) -> None:
        first, macro = self.i, len(self.facts.macros_inv)
        path = self.path("expr")
        if self.at("!") and not self.at("!=") and self.kind(1) == "open":
            self.eat("!")
            self.facts.macros_inv.insert(macro, self.occurrence(first, name=path.split("::")[-1], path=path, position="expr"))
            self.macro_body()
            self.facts.macros_inv[macro] |= {"_start": first, "_end": self.i}
            return
        self.after_path(first, struct)

    def after_path(self, first: int, struct: bool) -> None:
        if struct and self.text() == "{" and self.kind() == "open":
            close = self.closing()
            self.i += 1
            while self.i < close:
                self.attributes()
                if self.eat(".."):
                    if self.i < close:
                        self.expr()
                    break
                if self.kind() not in ("ident", "lit"):
                    self.fail("a field")
                if self.text(1) == ":" and not self.at("::", 1):
                    self.i += 2
                    self.expr()
                else:  # the short form is an expression of one name
                    self.path("expr")
                if not self.eat(","):
                    break
            if self.i != close:
                self.fail("a field")
            self.i += 1

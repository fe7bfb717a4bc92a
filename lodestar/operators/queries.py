"""Filter builders and finders. Each adds a condition; Catalyst sees one filter."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class _Query:
    """Conditions by slot; the last call to a slot wins. Builders aren't changed by their methods."""

    def __init__(self, base: DataFrame, slots: dict[str, Column] | None = None, **options):
        self.base, self.slots, self.options = base, slots or {}, options

    def _with(self, slot: str, condition: Column):
        return type(self)(self.base, self.slots | {slot: condition}, **self.options)

    def df(self) -> DataFrame:
        """The rows that meet every condition, lazily."""
        return self.base.where(reduce(lambda a, b: a & b, self.slots.values())) if self.slots else self.base

    def filter(self, condition: Column | Callable[[Row], bool]) -> DataFrame:
        """A column, or a Python function of a row where no column can say it (slow: it leaves the JVM)."""
        rows = self.df()
        if isinstance(condition, Column):
            return rows.where(condition)
        return rows.where(F.udf(lambda r: bool(condition(r)), "boolean")(F.struct(*rows.columns)))

    def collect(self) -> list[Row]:
        return self.df().orderBy("file_ord", "ord").collect()


class FunctionQuery(_Query):
    def public_only(self):
        return self._with("public", F.col("is_public"))

    def no_docs(self):
        return self._with("docs", ~F.col("has_docs"))

    def in_impl(self, ty: str):
        return self._with("impl", (F.col("kind.kind") == "ImplMethod") & (F.col("kind.self_ty") == ty))

    def impls_trait(self, trait: str):
        return self._with("impl_trait", F.col("kind.trait_ty") == trait)

    def in_trait(self, trait: str):
        return self._with("trait", F.col("kind.trait_name") == trait)

    def name_contains(self, text: str):
        return self._with("name", F.contains("name", F.lit(text)))

    named = name_contains

    def name_matches(self, pattern: str):
        """An unanchored regular expression; classes such as \\d and \\w are Unicode."""
        return self._with("regex", F.col("name").rlike(f"(?U){pattern}"))

    def returns(self, text: str):
        return self._with("returns", F.contains(F.coalesce("return_ty", F.lit("")), F.lit(text)))

    def takes_arg(self, text: str):
        return self._with("arg", F.exists("args", lambda a: F.contains(a, F.lit(text))))

    def is_async(self, on: bool = True):
        return self._with("async", F.col("is_async") == on)

    def is_unsafe(self, on: bool = True):
        return self._with("unsafe", F.col("is_unsafe") == on)

    def is_const(self, on: bool = True):
        return self._with("const", F.col("is_const") == on)

    def is_generic(self, on: bool = True):
        return self._with("generic", F.col("is_generic") == on)

    def has_attr(self, path: str):
        return self._with("attr", F.array_contains("attrs", path))


class ImportQuery(_Query):
    def root(self, name: str):
        return self._with("root", F.col("root") == name)

    def internal_only(self):
        return self._with("internal", F.col("is_internal"))

    def public_use_only(self):
        return self._with("public", F.col("is_public_use"))

    def full_path_starts_with(self, prefix: str):
        return self._with("prefix", F.startswith("full_path", F.lit(prefix)))

    def origin(self, name: str):
        return self if self.options.get("quirks") else self._with("origin", F.col("origin") == name)

    def workspace_only(self):
        return self.origin("WorkspaceMember")

    def deps_only(self):
        return self.origin("Dependency")

    def stdish_only(self):
        return self if self.options.get("quirks") else self._with("stdish", F.col("origin").isin("Std", "Core", "Alloc"))


class Finder:
    """Equality and substring lookups."""

    def __init__(self, corpus):
        self.corpus = corpus

    def paths_eq(self, path: str) -> DataFrame:
        return self.corpus.find_paths(path)

    def macros(self, name: str) -> DataFrame:
        return self.corpus.find_macro_invocations(name)

    def calls_containing(self, text: str) -> DataFrame:
        return self.corpus.find_calls(text)

    def _calls(self, name: str) -> DataFrame:
        return self.corpus.calls.where((F.col("callee") == name) | F.contains("callee", F.lit(f".{name}")))

    def unwrap_calls(self) -> DataFrame:
        return self._calls("unwrap")

    def expect_calls(self) -> DataFrame:
        return self._calls("expect")

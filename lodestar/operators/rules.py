"""Rules: plug-ins from a corpus to findings, run in the order they were added."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_object


class Rule(Protocol):
    code: str
    name: str

    def run(self, corpus) -> DataFrame:
        """severity, code, message, location, extra (JSON), file_ord, ord, part."""
        ...


def finding(rows: DataFrame, severity: str, code: str, message: Column, extra: dict[str, Column], part: int = 0) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), "location", json_object(**extra).alias("extra"), "file_ord", "ord", F.lit(part).alias("part"))


class UndocumentedPublicApi:
    code, name = "API001", "Undocumented public API"

    def run(self, corpus) -> DataFrame:
        rows = corpus.undocumented_public_api().df()
        return finding(rows, "Warn", self.code, F.concat(F.lit("public function missing docs: "), "fq_name"), {"signature": F.col("signature")})


class UnwrapInPublicApi:
    code, name = "API002", "Unwrap or expect in public API"

    def run(self, corpus) -> DataFrame:
        risky = F.contains("callee", F.lit("unwrap")) | F.contains("callee", F.lit("expect"))
        rows = corpus.calls.where(F.col("enclosing_public") & risky)
        message = F.concat(F.lit("panic-ish call inside public fn "), F.coalesce("enclosing_fn", F.lit("")), F.lit(": "), "callee")
        return finding(rows, "Warn", self.code, message, {"enclosing_fn": F.col("enclosing_fn"), "callee": F.col("callee")})


class PanicMacrosInPublicApi:
    code, name = "API003", "Panicking macros in public API"
    #: Fixed values.
    macros = ("panic", "todo", "unreachable")

    def run(self, corpus) -> DataFrame:
        rows = corpus.macros_inv.where(F.col("enclosing_public") & F.col("name").isin(*self.macros))
        message = F.concat(F.lit("macro "), "name", F.lit("! inside public fn "), F.coalesce("enclosing_fn", F.lit("")))
        return finding(rows, "Warn", self.code, message, {"enclosing_fn": F.col("enclosing_fn"), "macro": F.col("name")})


class StdInNoStdCrate:
    code, name = "API004", "std in a no_std crate"

    def run(self, corpus) -> DataFrame:
        no_std = corpus.no_std().scalar()  # a subquery: a broadcast of one row would end by its timeout while a large corpus is parsed
        imports = corpus.imports_df.where("root = 'std'").where(no_std)
        paths = corpus.paths.where((F.col("path") == "std") | F.startswith("path", F.lit("std::"))).where(no_std)
        a = finding(imports, "Deny", self.code, F.concat(F.lit("std import in no_std crate: "), "full_path"), {"import": F.col("full_path")}, 0)
        b = finding(paths, "Deny", self.code, F.concat(F.lit("std path in no_std crate: "), "path"), {"path": F.col("path"), "module": F.array_join("module_path", "::")}, 1)
        return a.unionByName(b)


#: In the order of their findings.
DEFAULT = (UndocumentedPublicApi, UnwrapInPublicApi, StdInNoStdCrate, PanicMacrosInPublicApi)


class RuleRunner:
    def __init__(self, corpus, rules: tuple[Rule, ...] = ()):
        self.corpus, self.rules = corpus, tuple(rules)

    def with_default_rules(self) -> RuleRunner:
        return RuleRunner(self.corpus, (*self.rules, *(r() for r in DEFAULT)))

    def add_rule(self, rule: Rule) -> RuleRunner:
        return RuleRunner(self.corpus, (*self.rules, rule))

    def run(self) -> DataFrame:
        """All findings, with rule_ord: a bag union, ordered by ordered()."""
        parts = [rule.run(self.corpus).withColumn("rule_ord", F.lit(i)) for i, rule in enumerate(self.rules)]
        if not parts:
            return UndocumentedPublicApi().run(self.corpus).withColumn("rule_ord", F.lit(0)).limit(0)
        return reduce(DataFrame.unionByName, parts)


def ordered(findings: DataFrame) -> DataFrame:
    """Rule by rule, each in file order."""
    return findings.orderBy("rule_ord", "part", "file_ord", "ord")

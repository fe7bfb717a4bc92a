"""The corpus: one DataFrame for each relation, and the entry points of every operator."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INTERNAL_ROOTS
from ..sources.errors import BY_KIND, ScanError
from ..sources.scan import facts
from . import containment, rules, snapshot, use_sites
from .imports import classify
from .queries import Finder, FunctionQuery, ImportQuery


class Corpus:
    """Facts of one crate's files. Relations are lazy until persist(); each is flattened once."""

    def __init__(self, facts_df: DataFrame, crate: str, members: list[str] | DataFrame, dependencies: list[str] | DataFrame, span_locations: bool, reference_quirks: bool):
        self.facts, self.crate, self.members, self.dependencies = facts_df, crate, members, dependencies
        self.span_locations, self.quirks = span_locations, reference_quirks
        self._made: dict[str, DataFrame] = {}
        self._level: StorageLevel | None = None

    @classmethod
    def from_sources(
        cls, files: DataFrame, crate: str, members=(), dependencies=(), span_locations: bool = False, reference_quirks: bool = False, relations: list[str] | None = None
    ) -> Corpus:
        """files: path, modified, file_ord, source (null: read the path)."""
        return cls(facts(files, crate, relations), crate, list(members), list(dependencies), span_locations, reference_quirks)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, flat: bool = True) -> Corpus:
        """Parse once, and keep each flat relation when it is first used, unless flat is off."""
        self.facts = self.facts.persist(level)
        self._level, self._made = level if flat else None, {}
        return self

    def unpersist(self) -> None:
        for df in (*self._made.values(), self.facts):
            df.unpersist()

    # -- relations

    def _flat(self, name: str) -> DataFrame:
        rows = self.facts.select("file_ord", F.col("path").alias("_file"), F.inline(name))
        if name == "fn_spans":
            positions = ["start_line", "start_col", "end_line", "end_col"]
            out = rows.withColumn("file", F.col("_file")).drop("_file")
            return out if self.span_locations else out.withColumns({p: F.lit(None).cast("long") for p in positions})
        line, column = (F.col("line"), F.col("column")) if self.span_locations else (F.lit(None).cast("long"), F.lit(None).cast("long"))
        return rows.withColumn("location", F.struct(F.col("_file").alias("path"), line.alias("line"), column.alias("column"))).drop("_file", "line", "column")

    def _kept(self, name: str, make) -> DataFrame:
        if name not in self._made:
            df = make()
            self._made[name] = df.persist(self._level) if self._level else df
        return self._made[name]

    def relation(self, name: str) -> DataFrame:
        return getattr(self, name)

    @property
    def files(self) -> DataFrame:
        return self.facts.select("path", "modified", "file_ord", "is_no_std_crate_root")

    @property
    def errors(self) -> DataFrame:
        return self.facts.where(F.col("_error").isNotNull()).select("_error.*")

    def raise_errors(self) -> None:
        bad = self.facts.where(F.col("_error").isNotNull()).orderBy("file_ord").select("_error.*").first()
        if bad:
            raise BY_KIND.get(bad["kind"], ScanError)(f"{bad['path']}: {bad['message']}")

    @property
    def functions_df(self) -> DataFrame:
        return self._kept("functions", lambda: self._flat("functions"))

    @property
    def _imports_raw(self) -> DataFrame:
        return self._kept("imports_raw", lambda: self._flat("imports"))

    @property
    def imports_df(self) -> DataFrame:
        def make():
            listed = self._imports_raw.where("listed").drop("listed", "raw_segments", "self_name")
            if self.quirks:  # classified before there is anything to classify
                return listed.withColumn("origin", F.lit(None).cast("string"))
            return classify(listed, self.members, self.dependencies)

        return self._kept("imports", make)

    @property
    def exports(self) -> DataFrame:
        return self._kept("exports", lambda: self._flat("exports"))

    @property
    def macros_def(self) -> DataFrame:
        return self._kept("macros_def", lambda: self._flat("macros_def"))

    @property
    def macros_inv(self) -> DataFrame:
        def make():
            rows = self._flat("macros_inv")
            return rows.where("position <> 'stmt'") if self.quirks else rows

        return self._kept("macros_inv", make)

    @property
    def paths(self) -> DataFrame:
        return self._kept("paths", lambda: self._flat("paths").where("keep").drop("keep"))

    @property
    def calls(self) -> DataFrame:
        return self._kept("calls", lambda: self._flat("calls"))

    @property
    def fn_spans(self) -> DataFrame:
        return self._kept("fn_spans", lambda: self._flat("fn_spans"))

    def imports_v1(self) -> DataFrame:
        """The earlier variant: top level only, no module path, `self` as it is written, no mark of absolute paths."""
        rows = self._imports_raw.where(F.size("module_path") == 0)
        raw = F.col("raw_segments")
        rows = rows.select("file_ord", "ord", F.get(raw, F.lit(0)).alias("root"), F.slice(raw, F.lit(2), F.size(raw)).alias("segments"), "is_public_use", "kind", F.array_join(raw, "::").alias("full_path"), "location")
        return rows.withColumn("is_internal", F.col("root").isin(*INTERNAL_ROOTS))

    def paths_v1(self) -> DataFrame:
        """The earlier variant: every path, without its enclosing function."""
        return self._flat("paths").drop("keep", "enclosing_fn", "enclosing_public")

    def macros_inv_v1(self) -> DataFrame:
        return self.macros_inv.drop("path", "enclosing_fn", "enclosing_public", "position")

    def calls_v1(self) -> DataFrame:
        return self.calls.drop("enclosing_fn", "enclosing_public", "callee_path")

    def no_std(self) -> DataFrame:
        """One row: whether any file has the inner attribute."""
        return self.facts.agg(F.coalesce(F.bool_or("is_no_std_crate_root"), F.lit(False)).alias("no_std"))

    def create_views(self, prefix: str = "") -> None:
        """Every relation as a temporary view, for SQL."""
        views = {"functions": self.functions_df, "imports": self.imports_df, "files": self.files}
        views |= {n: self.relation(n) for n in ("exports", "macros_def", "macros_inv", "paths", "calls", "fn_spans")}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)

    # -- operators

    def functions(self) -> FunctionQuery:
        return FunctionQuery(self.functions_df)

    def imports(self) -> ImportQuery:
        return ImportQuery(self.imports_df, quirks=self.quirks)

    def public_api(self) -> FunctionQuery:
        return self.functions().public_only()

    def undocumented_public_api(self) -> FunctionQuery:
        return self.public_api().no_docs()

    def public_surface(self) -> DataFrame:
        return self.exports

    def finder(self) -> Finder:
        return Finder(self)

    def find_paths(self, path: str) -> DataFrame:
        return self.paths.where(F.col("path") == path)

    def find_macro_invocations(self, name: str) -> DataFrame:
        return self.macros_inv.where(F.col("name") == name)

    def find_calls(self, text: str) -> DataFrame:
        return self.calls.where(F.contains("callee", F.lit(text)))

    def doc_coverage(self) -> DataFrame:
        """One row: public_total, public_documented, percent (100 when nothing is public)."""
        total, documented = F.count_if("is_public"), F.count_if(F.col("is_public") & F.col("has_docs"))
        percent = F.when(total == 0, F.lit(100.0)).otherwise(documented * 100.0 / total)
        return self.functions_df.agg(total.alias("public_total"), documented.alias("public_documented"), percent.alias("percent"))

    def enclosing(self, locations: DataFrame) -> DataFrame:
        return containment.enclosing(locations, self.fn_spans)

    def dep_use_sites(self, dependencies: list[str] | DataFrame) -> DataFrame:
        return use_sites.dependency_sites(self, dependencies)

    def internal_use_sites(self) -> DataFrame:
        return use_sites.internal_sites(self)

    def snapshot(self) -> snapshot.Snapshot:
        return snapshot.Snapshot.of(self)

    def diff_snapshot(self, old: snapshot.Snapshot) -> DataFrame:
        return self.snapshot().diff(old)

    def rules(self) -> rules.RuleRunner:
        return rules.RuleRunner(self)

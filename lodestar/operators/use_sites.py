"""Use sites: where a dependency, or the crate itself, is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_internal_root, norm_crate, scope, split_dep_path
from .imports import _is_one_of


def _from_imports(rows: DataFrame) -> DataFrame:
    head = F.coalesce(F.get("segments", F.lit(0)), F.lit("*"))
    where = scope(F.lit(None).cast("string"), F.col("module_path"))
    return rows.select(F.col("root").alias("dep"), F.col("full_path").alias("path"), head.alias("head"), F.lit("UseStmt").alias("kind"), "location", where.alias("scope"), "file_ord", "ord", F.lit(0).alias("branch_ord"))


def _split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_use", split_dep_path(F.col("path"))).where("_use is not null").withColumn("root", F.col("_use.dep"))


def _from_paths(rows: DataFrame, kind: str, branch: int) -> DataFrame:
    return rows.select(
        F.col("_use.dep").alias("dep"), F.col("_use.full").alias("path"), F.col("_use.head").alias("head"), F.lit(kind).alias("kind"), "location", scope(F.col("enclosing_fn"), F.col("module_path")).alias("scope"), "file_ord", "ord", F.lit(branch).alias("branch_ord")
    )


def _union(imports: DataFrame, paths: DataFrame, macros: DataFrame) -> DataFrame:
    return _from_imports(imports).unionByName(_from_paths(paths, "Path", 1)).unionByName(_from_paths(macros, "MacroCall", 2))


def dependency_sites(corpus, dependencies: list[str] | DataFrame) -> DataFrame:
    """dep, path, head, kind, location, scope for the named dependencies: imports, then paths, then macro calls.

    A macro call with a path counts twice, as a path and as a call.
    """

    def used(rows: DataFrame) -> DataFrame:
        return _is_one_of(rows, dependencies, "_used").where("_used").drop("_used")

    return _union(used(corpus.imports_df), used(_split(corpus.paths)), used(_split(corpus.macros_inv.where("path is not null"))))


def internal_sites(corpus) -> DataFrame:
    """The same for crate, self, super and the crate's own name."""
    own: Column = is_internal_root(F.col("root"), corpus.crate)
    return _union(corpus.imports_df.where(own), _split(corpus.paths).where(own), _split(corpus.macros_inv.where("path is not null")).where(own))


def counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("dep", "path").agg(F.count("*").alias("n"))


def by_dependency(sites: DataFrame) -> DataFrame:
    """dep and a map of its paths to their counts."""
    return counts(sites).groupBy(norm_crate(F.col("dep")).alias("dep")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "n")))).alias("paths"))

"""Imports: classification, de-duplication, grouping and summary. All are DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_crate, origin_or_unknown, origin_rank

KEY = ["full_path", "kind", "is_absolute"]
#: Name sets up to this size become a list in the plan; larger ones are joined.
LISTED_NAMES = 1_000


def _is_one_of(rows: DataFrame, names: list[str] | DataFrame, flag: str) -> DataFrame:
    root = norm_crate(F.col("root"))
    if isinstance(names, DataFrame):
        known = names.select(norm_crate(F.col(names.columns[0])).alias("_name")).distinct()
    elif len(names) <= LISTED_NAMES:
        return rows.withColumn(flag, root.isin(*[n.replace("-", "_") for n in names]) if names else F.lit(False))
    else:
        known = rows.sparkSession.createDataFrame([(n.replace("-", "_"),) for n in set(names)], "_name string")
    return rows.join(known.withColumn(flag, F.lit(True)), root == F.col("_name"), "left").drop("_name").withColumn(flag, F.coalesce(flag, F.lit(False)))


def classify(imports: DataFrame, members: list[str] | DataFrame, dependencies: list[str] | DataFrame) -> DataFrame:
    """Adds origin: internal, then standard crates, then workspace members, then dependencies, else unknown."""
    rows = _is_one_of(_is_one_of(imports.drop("origin"), members, "_member"), dependencies, "_dependency")
    root = F.col("root")
    origin = (
        F.when(F.col("is_internal"), "Internal").when(root == "std", "Std").when(root == "core", "Core").when(root == "alloc", "Alloc")
        .when(F.col("_member"), "WorkspaceMember").when(F.col("_dependency"), "Dependency").otherwise("UnknownExternal")
    )
    return rows.withColumn("origin", origin).drop("_member", "_dependency")


def _first_by(rows: DataFrame, key: list[str], *order) -> DataFrame:
    window = Window.partitionBy(*key)
    ranked = rows.withColumn("_rank", F.row_number().over(window.orderBy(*order, "file_ord", "ord")))
    return ranked.withColumn("_first", F.min(F.struct("file_ord", "ord")).over(window)).where("_rank = 1").drop("_rank")


def unique(imports: DataFrame) -> DataFrame:
    """The first of each (path, kind with alias, absolute, public)."""
    return _first_by(imports, [*KEY, "is_public_use"]).drop("_first")


def unique_prefer_pub_use(imports: DataFrame) -> DataFrame:
    """One row for each (path, kind with alias, absolute): the first public one, else the first.

    first_file_ord and first_ord are the place of the key's first occurrence, where the row stands.
    """
    rows = _first_by(imports, KEY, F.desc("is_public_use"))
    return rows.select("*", F.col("_first.file_ord").alias("first_file_ord"), F.col("_first.ord").alias("first_ord")).drop("_first")


def in_order(imports: DataFrame) -> DataFrame:
    by = ["first_file_ord", "first_ord"] if "first_ord" in imports.columns else ["file_ord", "ord"]
    return imports.orderBy(*by)


def group_by_origin(imports: DataFrame) -> DataFrame:
    """origin, its rank in the order of display, n, and the rows' paths in order.

    A group is one row here, for corpora whose groups fit in one; rows_by_origin() has no such bound.
    """
    origin = origin_or_unknown(F.col("origin"))
    return _grouped(imports.withColumn("origin", origin), "origin").withColumn("origin_rank", origin_rank(F.col("origin")).cast("long"))


def group_by_root(imports: DataFrame) -> DataFrame:
    return _grouped(imports, "root")


def rows_by_origin(imports: DataFrame) -> DataFrame:
    """Every import with its origin's rank and count: the groups as rows, however large they are."""
    rows = imports.withColumn("origin", origin_or_unknown(F.col("origin")))
    return _counted(rows, "origin").withColumn("origin_rank", origin_rank(F.col("origin")).cast("long"))


def rows_by_root(imports: DataFrame) -> DataFrame:
    return _counted(imports, "root")


def _counted(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(counts, key)


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("file_ord", "ord", "full_path")))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.transform(listed, lambda r: r["full_path"]).alias("full_paths"))


def summary_counts(imports: DataFrame) -> DataFrame:
    """Counts by origin, by root and overall in one pass: (section, key, n)."""
    rows = imports.withColumn("origin", origin_or_unknown(F.col("origin")))
    counters = {
        "total": F.lit(True), "pub_use": F.col("is_public_use"), "glob": F.col("kind.kind") == "Glob", "rename": F.col("kind.kind") == "Rename", "absolute": F.coalesce("is_absolute", F.lit(False)),
    }
    sets = rows.groupingSets([["origin"], ["root"], []], "origin", "root").agg(F.grouping_id().alias("_set"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    overall = [F.struct(F.lit(n).alias("section"), F.lit(None).cast("string").alias("key"), F.col(n).alias("n")) for n in counters]
    one = lambda s, k: F.array(F.struct(F.lit(s).alias("section"), F.col(k).alias("key"), F.col("total").alias("n")))
    by = F.when(F.col("_set") == 1, one("by_origin", "origin")).when(F.col("_set") == 2, one("by_root", "root")).otherwise(F.array(*overall))
    return sets.select(F.inline(by))


def summary(imports: DataFrame) -> DataFrame:
    """One row: total, by_origin and by_root maps, pub_use, glob, rename and absolute counts."""
    rows = summary_counts(imports)
    pick = lambda s: F.coalesce(F.max(F.when(F.col("section") == s, F.col("n"))), F.lit(0)).alias(s)
    as_map = lambda s: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct("key", "n"))))).alias(s)
    return rows.agg(pick("total"), as_map("by_origin"), as_map("by_root"), pick("pub_use"), pick("glob"), pick("rename"), pick("absolute"))

"""Scalar functions over paths, crate names and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roots inside the crate, and origins in their order of display.
INTERNAL_ROOTS = ("crate", "self", "super")
ORIGINS = ("Internal", "Std", "Core", "Alloc", "WorkspaceMember", "Dependency", "UnknownExternal")


def norm_crate(name: Column) -> Column:
    """A crate name as paths spell it."""
    return F.translate(name, "-", "_")


def split_dep_path(path: Column) -> Column:
    """struct(dep, head, full) of `dep::head::…`, one leading `::` ignored; null for a single segment."""
    clean = F.regexp_replace(F.regexp_replace(path, r"(?U)^\s+|\s+$", ""), r"^::", "")
    parts = F.split(clean, "::")
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("dep"), F.get(parts, F.lit(1)).alias("head"), clean.alias("full")))


def scope(enclosing_fn: Column, module_path: Column) -> Column:
    """The enclosing function, else the module, else `file`."""
    return F.coalesce(enclosing_fn, F.when(F.size(module_path) == 0, F.lit("file")).otherwise(F.concat(F.lit("crate::"), F.array_join(module_path, "::"))))


def is_internal_root(root: Column, crate: str) -> Column:
    return root.isin(*INTERNAL_ROOTS) | (norm_crate(root) == norm_crate(F.lit(crate)))


def origin_or_unknown(origin: Column) -> Column:
    return F.coalesce(origin, F.lit("UnknownExternal"))


def origin_rank(origin: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORIGINS)), origin)


def signature_hash(signature: Column) -> Column:
    """Only its equality is used."""
    return F.sha2(signature, 256)


def fq_name(crate: str, module_path: Column, kind: Column, name: Column) -> Column:
    owner = F.coalesce(kind["trait_name"], kind["self_ty"])
    return F.concat_ws("::", F.lit(crate), F.when(F.size(module_path) > 0, F.array_join(module_path, "::")), owner, name)


def truncate(text: Column, most: int = 31) -> Column:
    """Texts of more than `most` bytes end in three dots."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def json_object(**columns: Column) -> Column:
    """A JSON object with its keys in order; null values stay."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def place(location: Column) -> Column:
    """`path:line:column`, 0 where unknown."""
    return F.format_string("%s:%d:%d", location["path"], F.coalesce(location["line"], F.lit(0)), F.coalesce(location["column"], F.lit(0)))

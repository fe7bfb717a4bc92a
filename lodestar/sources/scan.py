"""From directories to the facts of every source file."""

from __future__ import annotations

import glob
import os
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from itertools import accumulate, chain, repeat
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..rust.lexer import SourceError
from ..rust.parser import Facts
from ..rust.templates import Templates, Whole, templates_of
from .errors import ManifestFailure
from .globs import GENERATED, glob_regex
from .schema import RELATIONS, facts_schema

LISTING = "path string, modified timestamp, length bigint, discovery_ord bigint"
BATCH_FILES = 256
#: Files in a batch of facts.
BATCH_ROWS = 2_048
#: Characters of text after which a batch of facts ends.
BATCH_TEXT = 1 << 20


@dataclass(frozen=True)
class SourceScan:
    """A lazy description of what to scan; every method returns a new one, in any order."""

    crate: str
    roots: tuple[str, ...] = ()
    workspaces: tuple[str, ...] = ()
    members: tuple[str, ...] = ()
    tests: bool = False
    examples: bool = False
    benches: bool = False
    includes: tuple[str, ...] = ("**/*.rs",)
    excludes: tuple[str, ...] = ()
    links: bool = False
    max_size: int | None = None
    permissive: bool = False
    newest: int | None = None
    locations: bool = False
    quirks: bool = False

    def scan_in_folder(self, path: str) -> SourceScan:
        return replace(self, roots=(*self.roots, str(path)))

    scan_file = scan_in_folder

    def scan_workspace_root(self, root: str) -> SourceScan:
        return replace(self, workspaces=(*self.workspaces, str(root)))

    def only_members(self, names: list[str]) -> SourceScan:
        return replace(self, members=tuple(names))

    def include_tests(self, on: bool = True) -> SourceScan:
        return replace(self, tests=on)

    def include_examples(self, on: bool = True) -> SourceScan:
        return replace(self, examples=on)

    def include_benches(self, on: bool = True) -> SourceScan:
        return replace(self, benches=on)

    def include_glob(self, pattern: str) -> SourceScan:
        glob_regex(pattern)
        return replace(self, includes=(*self.includes, pattern))

    def default_include(self, on: bool) -> SourceScan:
        """Whether all source files are included before any include_glob()."""
        return replace(self, includes=tuple(p for p in self.includes if p != "**/*.rs") if not on else self.includes)

    def exclude_glob(self, pattern: str) -> SourceScan:
        glob_regex(pattern)
        return replace(self, excludes=(*self.excludes, pattern))

    def exclude_generated(self) -> SourceScan:
        return replace(self, excludes=(*self.excludes, *GENERATED))

    def follow_links(self, on: bool = True) -> SourceScan:
        return replace(self, links=on)

    def max_file_size(self, n: int) -> SourceScan:
        return replace(self, max_size=n)

    def ignore_parse_errors(self, on: bool = True) -> SourceScan:
        return replace(self, permissive=on)

    def only_newest(self, n: int) -> SourceScan:
        return replace(self, newest=n)

    def span_locations(self, on: bool = True) -> SourceScan:
        return replace(self, locations=on)

    def reference_quirks(self, on: bool = True) -> SourceScan:
        return replace(self, quirks=on)

    def resolve(self) -> tuple[list[str], list[str], list[str]]:
        """All roots, the names of workspace members and of declared dependencies."""
        roots, members, deps = list(self.roots), set(), set()
        for root in self.workspaces:
            found = Workspace.read(root)
            members |= set(found.packages)
            deps |= found.dependencies
            for name, where in found.packages.items():
                if self.members and name not in self.members:
                    continue
                for sub, wanted in (("src", True), ("tests", self.tests), ("examples", self.examples), ("benches", self.benches)):
                    if wanted and (where / sub).is_dir():
                        roots.append(str(where / sub))
        return roots, sorted(m.replace("-", "_") for m in members), sorted(d.replace("-", "_") for d in deps)

    def listing(self, spark: SparkSession) -> DataFrame:
        """Every file below the roots: path, modified, length, discovery_ord.

        Roots that are URIs (s3a://, hdfs://, file://) are listed by Spark, where the files are many on its
        executors; Spark leaves out names that begin with a dot or an underscore. Local paths are walked
        here; only names and sizes pass the driver.
        """
        roots = self.resolve()[0]
        rows = list(walk([r for r in roots if "://" not in r], self.links, unique=not self.quirks))
        out = spark.createDataFrame(rows, LISTING)
        stored = [r for r in roots if "://" in r]
        if not stored:
            return out
        # in the order of the paths; a range of them is one partition, so numbers grow from range to range
        found = _stored(spark, stored).select("path", F.col("modificationTime").alias("modified"), "length")
        found = found.distinct().repartitionByRange("path").sortWithinPartitions("path")
        return out.unionByName(found.withColumn("discovery_ord", F.monotonically_increasing_id() + F.lit(len(rows))))

    def chosen(self, listing: DataFrame) -> DataFrame:
        """The listing's files to read: globs and extension, then the newest, then the size bound."""
        return choose(listing, list(self.includes), list(self.excludes), self.newest, self.max_size)

    def parse(self, spark: SparkSession):
        """Read and parse: a Corpus. Raises on the first bad file unless errors are ignored."""
        from ..operators.corpus import Corpus

        _, members, deps = self.resolve()
        files = self.chosen(self.listing(spark)).withColumn("file_ord", F.col("discovery_ord")).withColumn("source", F.lit(None).cast("binary"))
        stored = [r for r in self.resolve()[0] if "://" in r]
        if stored:
            files = _with_bytes(spark, files.drop("source").persist(), stored)
        parallelism = spark.sparkContext.defaultParallelism
        spread = files.repartition(max(parallelism, min(20_000, files.count() // BATCH_FILES)), "discovery_ord")
        corpus = Corpus.from_sources(spread, self.crate, members, deps, span_locations=self.locations, reference_quirks=self.quirks).persist()
        if not self.permissive or self.quirks:
            corpus.raise_errors()
        return corpus


def _stored(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Source files below URIs, read by Spark's own reader: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rs").load(roots)


def _with_bytes(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """The chosen files with their bytes; no older file than the oldest chosen one, nor a longer one, is opened."""
    bounds = files.agg(F.min("modified"), F.max("length")).first()
    read = _stored(spark, roots)
    if bounds[0] is not None:
        read = read.where((F.col("modificationTime") >= F.lit(bounds[0])) & (F.col("length") <= F.lit(bounds[1])))
    return files.join(read.select("path", F.col("content").alias("source")).dropDuplicates(["path"]), "path", "left")


def choose(listing: DataFrame, includes: list[str], excludes: list[str] | None = None, newest: int | None = None, max_size: int | None = None) -> DataFrame:
    """Source files of a listing that match an include, and no exclude; then the newest; then those small enough."""
    path = F.col("path")
    keep = path.rlike(r"[^/]\.rs$")
    keep &= path.rlike("|".join(f"(?:{glob_regex(p)})" for p in includes)) if includes else F.lit(False)
    if excludes:
        keep &= ~path.rlike("|".join(f"(?:{glob_regex(p)})" for p in excludes))
    out = listing.where(keep)
    if newest is not None:
        out = out.orderBy(F.coalesce("modified", F.lit(0).cast("timestamp")).desc(), F.desc("discovery_ord")).limit(newest)
    return out if max_size is None else out.where(F.col("length") <= max_size)


def walk(roots: list[str], follow: bool, unique: bool) -> Iterator[tuple]:
    """(path, modified, length, ord) of all files; unreadable entries and missing roots are skipped."""
    seen: set[str] = set()
    ord_ = 0

    def entry(path: str) -> Iterator[tuple]:
        nonlocal ord_
        if unique and path in seen:
            return
        try:
            stat = os.stat(path)
        except OSError:
            return
        seen.add(path)
        yield path, datetime.fromtimestamp(stat.st_mtime, timezone.utc), stat.st_size, ord_
        ord_ += 1

    for root in roots:
        if os.path.isfile(root):
            yield from entry(root)
            continue
        visited: set[str] = set()
        for folder, folders, names in os.walk(root, followlinks=follow):
            real = os.path.realpath(folder)
            if real in visited:  # a loop of links
                folders[:] = []
                continue
            visited.add(real)
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                if os.path.isfile(path) and (follow or not os.path.islink(path)):
                    yield from entry(path)


@dataclass
class Workspace:
    packages: dict[str, Path] = field(default_factory=dict)
    dependencies: set[str] = field(default_factory=set)

    @classmethod
    def read(cls, root: str) -> Workspace:
        """From the manifests below a root: its members, and all dependencies they declare by package name."""
        out, base = cls(), Path(root)
        base = base.parent if base.name == "Cargo.toml" else base
        top = _manifest(base)
        places = [base] if "package" in top else []
        space = top.get("workspace", {})
        skipped = {p.resolve() for pattern in space.get("exclude", []) for p in map(Path, glob.glob(str(base / pattern)))}
        for pattern in space.get("members", []):
            for p in sorted(map(Path, glob.glob(str(base / pattern)))):
                if (p / "Cargo.toml").is_file() and p.resolve() not in skipped:
                    places.append(p)
        shared = space.get("dependencies", {})
        for place in places:
            spec = _manifest(place)
            name = spec.get("package", {}).get("name")
            if name is None:
                raise ManifestFailure(f"{place}/Cargo.toml names no package")
            out.packages[name] = place
            for part in [spec, *spec.get("target", {}).values()]:
                for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
                    for alias, dep in part.get(kind, {}).items():
                        dep = shared.get(alias, dep) if isinstance(dep, dict) and dep.get("workspace") else dep
                        out.dependencies.add(dep.get("package", alias) if isinstance(dep, dict) else alias)
        return out


def _manifest(folder: Path) -> dict:
    try:
        return tomllib.loads((folder / "Cargo.toml").read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ManifestFailure(f"{folder}/Cargo.toml: {e}") from e


def facts(files: DataFrame, crate: str, relations: list[str] | None = None) -> DataFrame:
    """One row of facts a file, from rows (path, modified, file_ord, source); source is text or UTF-8 bytes,
    and a null one is read from its path.

    The only custom stage: everything after it is built-in DataFrame operations. A file that can't be
    read or parsed gives a row with _error and empty facts, never a failed task.
    """
    names = list(RELATIONS) if relations is None else relations
    schema = facts_schema(names)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = templates_of(crate, tuple(names))
        columns = WholeColumns(templates, arrow)
        for batch in batches:
            first, found, size = 0, [], 0
            for at in range(0, batch.num_rows, BATCH_FILES):  # texts are read a few at a time
                part = batch.slice(at, BATCH_FILES)
                for i, (path, source) in enumerate(zip(part["path"].to_pylist(), part["source"].to_pylist()), at + 1):
                    found.append(_file(path, source, templates))
                    size += len(source or "")
                    if len(found) == BATCH_ROWS or size > BATCH_TEXT:
                        yield from _batches(batch.slice(first, len(found)), found, columns)
                        first, found, size = i, [], 0
                        if templates.full():
                            templates.forget()
            if found:
                yield from _batches(batch.slice(first), found, columns)

    return files.select("path", "modified", "file_ord", "source").mapInArrow(run, schema)


def _file(path: str, source: str | bytes | None, templates: Templates) -> Facts | tuple[Whole, list[str]] | dict:
    """The facts of a file, as they are or as a whole template's and runs, or its error."""
    try:
        text = source
        if text is None:
            with open(path, "rb") as f:  # a folder that all executors see; others are read by Spark
                text = f.read()
        if isinstance(text, bytes | bytearray):
            text = bytes(text).decode("utf-8")
        return templates.read(text)
    except (OSError, UnicodeDecodeError) as e:
        return {"kind": "io", "path": path, "message": str(e)}
    except (SourceError, RecursionError, IndexError, KeyError) as e:
        return {"kind": "parse", "path": path, "message": str(e)}


def _batches(files: pa.RecordBatch, found: list[Facts | tuple[Whole, list[str]] | dict], columns: WholeColumns) -> Iterator[pa.RecordBatch]:
    """The facts rows of files: of those with whole templates, then of the others."""
    wholes = [f for f in found if f.__class__ is tuple]
    if len(wholes) == len(found):
        yield columns.batch(files, wholes)
    elif not wholes:
        yield _batch(files, found, columns.schema)
    else:
        is_whole = np.fromiter((f.__class__ is tuple for f in found), bool, len(found))
        yield columns.batch(files.filter(pa.array(is_whole)), wholes)
        yield _batch(files.filter(pa.array(~is_whole)), [f for f in found if f.__class__ is not tuple], columns.schema)


class WholeColumns:
    """Facts rows of files with whole templates: rows are taken from all different ones by their places, and only what
    differs from file to file is made anew."""

    def __init__(self, templates: Templates, schema: pa.Schema):
        self.templates, self.schema = templates, schema

    def batch(self, files: pa.RecordBatch, found: list[tuple[Whole, list[str]]]) -> pa.RecordBatch:
        wholes = [w for w, _ in found]
        texts = [t for w, runs in found if w.texts for t in w.texts(runs)]
        numbers = [n for w, runs in found if w.numbers for n in w.numbers(runs)]
        values = pa.array(texts, pa.string()), pa.array(numbers, pa.int64())
        firsts = _starts([w.text_count for w in wholes]), _starts([w.number_count for w in wholes])
        columns = []
        for column in self.schema:
            if column.name in ("path", "modified", "file_ord"):
                columns.append(files[column.name].cast(column.type))
            elif column.name == "is_no_std_crate_root":
                columns.append(pa.array(np.zeros(len(wholes), bool)))
            elif column.name == "_error":
                columns.append(pa.nulls(len(wholes), column.type))
            else:
                columns.append(self._lists(column.name, column.type, wholes, values, firsts))
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def _lists(self, name: str, type_: pa.ListType, wholes: list[Whole], values: tuple[pa.Array, pa.Array], firsts: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
        """One list of numbered rows a file."""
        none: tuple[list[int], dict[str, list[int]]] = ([], {})
        parts = [w.rows.get(name, none) for w in wholes]
        counts = np.array([len(ids) for ids, _ in parts], np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        fields = list(type_.value_type)
        if not ends[-1]:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([], type_.value_type), type=type_)
        ids = np.fromiter(chain.from_iterable(ids for ids, _ in parts), np.int64, ends[-1])
        known = self._known(name, fields)
        columns = []
        for field_, rows in zip(fields, known):
            if field_.name == "ord":
                columns.append(pa.array(np.arange(ends[-1]) - np.repeat(ends[:-1], counts), field_.type))
                continue
            places = ids
            if field_.name in self.templates.differing[name]:
                number = pa.types.is_integer(field_.type)
                at = np.fromiter(chain.from_iterable(differ.get(field_.name) or repeat(-1, len(rows_)) for rows_, differ in parts), np.int64, ends[-1])
                places = np.where(at < 0, ids, len(rows) + np.repeat(firsts[number], counts) + at)
                rows = pa.concat_arrays([rows, values[number]])
            columns.append(rows.take(pa.array(places)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), type=type_)

    def _known(self, name: str, fields: list[pa.Field]) -> list[pa.Array]:
        """The columns of all different rows of a relation."""
        rows = self.templates.rows[name]
        made = self.templates.columns.get(name) or [pa.array([], f.type) for f in fields]
        if len(made[0]) < len(rows):
            new = rows[len(made[0]) :]
            made = [pa.concat_arrays([old, pa.array([r.get(f.name) for r in new], f.type)]) for old, f in zip(made, fields)]
            self.templates.columns[name] = made
        return made


def _starts(counts: list[int]) -> np.ndarray:
    return np.cumsum([0, *counts[:-1]])


def _batch(files: pa.RecordBatch, found: list[Facts | dict], schema: pa.Schema) -> pa.RecordBatch:
    """The facts rows of files, column by column."""
    errors = [f if f.__class__ is dict else None for f in found]
    facts = [Facts() if f.__class__ is dict else f for f in found] if any(errors) else found
    error = schema.field("_error").type
    made = {"is_no_std_crate_root": pa.array([f.no_std for f in facts], pa.bool_()), "_error": pa.array(errors, error) if any(errors) else pa.nulls(len(errors), error)}
    columns = []
    for column in schema:
        if column.name in ("path", "modified", "file_ord"):
            columns.append(files[column.name].cast(column.type))
        elif column.name in made:
            columns.append(made[column.name])
        else:
            columns.append(_lists([getattr(f, column.name) for f in facts], column.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _lists(lists: list[list[dict]], type_: pa.ListType) -> pa.Array:
    """One list of numbered rows a file."""
    ends = list(accumulate(map(len, lists), initial=0))
    if not ends[-1]:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([], type_.value_type), type=type_)
    rows = [r for rows in lists for r in rows]
    ords = [i for rows in lists for i in range(len(rows))]
    fields = list(type_.value_type)
    names = [f.name for f in fields if f.name != "ord"]
    found = dict(zip(names, zip(*map(itemgetter(*names), rows))))
    values = [pa.array(ords, f.type) if f.name == "ord" else _column(found[f.name], f.type) for f in fields]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=fields), type=type_)


def _column(values: tuple | list, type_: pa.DataType) -> pa.Array:
    if pa.types.is_struct(type_) and None not in values:
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in type_], fields=list(type_))
    return pa.array(values, type_)

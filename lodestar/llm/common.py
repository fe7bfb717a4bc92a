"""Shared plumbing: the shared folder, durable intermediates, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests in local mode)
    a temporary folder is made once per session and removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_lodestar_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext._lodestar_shared = own
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


#: Bytes of one Arrow batch between the JVM and a Python worker; both hold a few at a time, outside the heap.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """df, after making sure that its session sends long texts to Python in small batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None)
    if now is None or not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > most:
        conf.set(key, str(most))
    return df


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestar-{what}-{uuid.uuid4().hex}"


#: Spark's setting that deletes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scope:
    """The intermediates of one operator's call. What isn't kept for its result goes as it returns."""

    def __init__(self) -> None:
        self.made: dict[str, DataFrame] = {}
        self.kept: dict[str, DataFrame] = {}

    def keep(self, *frames: DataFrame | None) -> None:
        """Intermediates that the result reads: they're the enclosing scope's from then on, or stay."""
        for df in frames:
            if df is not None:
                self.kept[df._lodestar_path] = df

    def keep_rest(self) -> None:
        """Keep all that the operators called inside have kept, and what was made beside them."""
        self.kept |= self.made


_open = threading.local()


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Frees what written() makes inside, but for what is kept; all of it after an error."""
    stack = _open.__dict__.setdefault("stack", [])
    own = Scope()
    stack.append(own)
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        stack.pop()
        for path, df in own.made.items():
            if path not in own.kept:
                _delete(df.sparkSession, path)
        if stack:
            stack[-1].made |= own.kept


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors.

    Its shuffle files go at once, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    for own in _open.__dict__.get("stack", [])[-1:]:
        own.made[path] = out
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete intermediates that written() made and that nothing reads any more."""
    for df in frames:
        if df is None:
            continue
        _delete(df.sparkSession, df._lodestar_path)
        for own in _open.__dict__.get("stack", []):
            own.made.pop(df._lodestar_path, None)
            own.kept.pop(df._lodestar_path, None)


def release(held: Scope, docs: DataFrame) -> None:
    """Delete what a scope kept, but for what docs reads."""
    if held.kept:
        files = docs.inputFiles()
        for path in list(held.kept):
            if not any(path.rpartition("/")[2] in f for f in files):
                _delete(docs.sparkSession, path)
                del held.kept[path]


_claimed: tuple[str, Callable[[], None]] | None = None


def claim(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called by a Python worker as it starts a task of `owner`: frees what another operator kept there.

    Workers are reused, so one operator's caches would otherwise stay while others run.
    """
    global _claimed
    if _claimed is None or _claimed[0] != owner:
        if _claimed is not None:
            _claimed[1]()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)
        _claimed = (owner, clear)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node.

    Alternating large-star and small-star steps. Every step is a partial aggregate and an
    equi-join of two written tables, so a hub's rows are combined before the shuffle and adaptive
    execution may split them in the join. Every round is written, so a lost executor costs its
    tasks only. Rounds grow with the logarithm of the node count. Nodes without edges aren't
    returned. Self loops are ignored.
    """
    with scope() as held:
        pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
        now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        while True:
            both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = written(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "cc-low")
            # large star: every larger neighbour of u hangs on u's minimum
            large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
            # small star: u and its smaller neighbours hang on the smallest of them
            least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
            hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            nxt = written(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
            discard(now, low, large, least)
            now = nxt
            # done when all that is left are stars: a node hangs on one other, which hangs on none
            ends = now.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionAll(now.select(F.col("v").alias("x"), F.lit(0).alias("n")))
            if is_empty(ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 or n = 1 and least = 0")):
                break
        held.keep(now)
        roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
        return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

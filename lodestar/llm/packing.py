"""Best-fit packing by linear grouping.

The plan needs only the histogram of piece lengths, which has at most `capacity` rows at any
input size. Large lengths are rounded up to the maxima of groups of equal cardinality; for these
few sizes configurations are optimised by column generation; each configuration's slots then
get actual lengths from their group, longest first; what is left is placed best-fit, longest
first. The plan has a bounded number of rows too: each says that pieces of one length, from
one rank to another, go to consecutive sequences at one offset.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scope, written
from .units import shared_library_encoder, slices

GROUPS = 48
#: Shares of the capacity above which a length counts as large; the plan with the fewest sequences wins.
LARGE = (1 / 4, 2 / 5, 1 / 2)
BUCKET_ROWS = 100_000


@dataclass
class Run:
    """`count` consecutive sequences, each holding the same lengths; items: (length, first rank)."""

    first: int
    count: int
    free: int
    items: list[tuple[int, int]] = field(default_factory=list)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Whole numbers of configurations that cover at most the demand, from the cutting-stock LP.

    A revised simplex: the start is one configuration a size; a knapsack over the duals gives the
    next column until none improves by more than 1e-6.
    """
    n = len(sizes)
    size = np.array(sizes)
    columns = [np.eye(n, dtype=int)[i] * (capacity // sizes[i]) for i in range(n)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        dual = np.ones(n) @ inverse
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(min(sizes), capacity + 1):
            fits = size <= c
            value = np.where(fits, best[c - np.where(fits, size, c)] + dual, -1.0)
            i = int(value.argmax())
            if value[i] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[i], i
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-6:
            break
        column, c = np.zeros(n, int), capacity
        while c > 0:
            if pick[c] < 0 or best[c] == best[c - 1]:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        move = inverse @ column
        able = move > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, move, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * move
        x[out] = ratio[out]
        inverse[out] /= move[out]
        inverse -= np.outer(np.where(np.arange(n) == out, 0, move), inverse[out])
        columns[out] = column
    return [(columns[i].tolist(), int(np.floor(x[i] + 1e-9))) for i in range(n) if x[i] >= 1]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """The best of the plans for each bound of LARGE."""
    return min((plan_for(histogram, capacity, share, groups) for share in LARGE), key=lambda runs: sum(r.count for r in runs))


def plan_for(histogram: dict[int, int], capacity: int, share: float, groups: int) -> list[Run]:
    """Runs of sequences that hold every piece of the histogram once."""
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    rank: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    opened = 0

    def open_run(count: int) -> Run:
        nonlocal opened
        runs.append(Run(opened, count, capacity))
        opened += count
        return runs[-1]

    def put(run: Run, s: int) -> None:
        run.items.append((s, rank[s]))
        run.free -= s
        rank[s] += run.count
        left[s] -= run.count

    if left.get(capacity):
        put(open_run(left[capacity]), capacity)
    large = sorted(s for s in left if capacity * share < s < capacity)
    total = sum(left[s] for s in large)
    if total:
        # groups of equal cardinality: bounds are the maxima; a length belongs to the first bound >= it
        bounds, run_sum, k = [], 0, min(groups, len(large))
        for s in reversed(large):
            if run_sum >= len(bounds) * total / k:
                bounds.append(s)
            run_sum += left[s]
        bounds.sort()
        member = {s: min(b for b in bounds if b >= s) for s in large}
        stock = {b: [s for s in reversed(large) if member[s] == b] for b in bounds}
        need = {b: sum(left[s] for s in stock[b]) for b in bounds}
        for column, times in sorted(configurations(bounds, [need[b] for b in bounds], capacity), key=lambda c: -sum(k * b for k, b in zip(c[0], bounds))):
            slots = [b for b, k in zip(bounds, column) for _ in range(k)]
            while times > 0 and all(stock[b] for b in set(slots)):
                # actual lengths for the slots, as long as none of them runs out
                chosen, used = [], defaultdict(int)
                for b in slots:
                    s = next((s for s in stock[b] if left[s] > used[s]), None)
                    if s is None:
                        break
                    used[s] += 1
                    chosen.append(s)
                if len(chosen) < len(slots):
                    break
                count = min(times, *(left[s] // k for s, k in used.items()))
                run = open_run(count)
                for s in chosen:
                    put(run, s)
                times -= count
                for b in set(slots):
                    stock[b] = [s for s in stock[b] if left[s] > 0]
    # best fit, longest first; by_free holds the runs of each free length
    by_free: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_free[run.free].append(run)
    for s in sorted((s for s in left if left[s] > 0), reverse=True):
        free = s
        while left[s] > 0 and free <= capacity:
            if not by_free[free]:
                free += 1
                continue
            run = by_free[free].pop()
            each = min(free // s, left[s])
            count = min(run.count, left[s] // each)
            if count < run.count:  # the rest of the run stays as it is
                rest = Run(run.first + count, run.count - count, run.free, [(t, r + count) for t, r in run.items])
                run.count = count
                by_free[free].append(rest)
                runs.append(rest)
            for _ in range(each):
                put(run, s)
            by_free[run.free].append(run)
        if left[s] > 0:
            each = min(capacity // s, left[s])
            while left[s] > 0:
                each = min(each, left[s])
                run = open_run(left[s] // each)
                for _ in range(each):
                    put(run, s)
                by_free[run.free].append(run)
    return runs


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the first piece of a long document is the shorter one."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_library_encoder(tokenizer_path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, ends = enc(texts)
                raw, out = ids.astype("<u4").tobytes(), []
                for doc_id, a, b in zip(batch.column(0).slice(at, len(texts)).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    n, own = b - a + 1, raw[4 * a : 4 * b] + end.tobytes()
                    cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    out += [(doc_id, k, x, y - x, zlib.crc32(own[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(cut, cut[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place all pieces of all documents: the columns of pieces(), sequence_id and offset.

    Ranks within a length are dealt over hash buckets of about BUCKET_ROWS rows, so no task
    orders more rows than that, however common a length is. Null and empty texts are one end id.
    Repeated rows are packed each. An empty table gives an empty result.
    """
    with scope() as held:
        cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
        held.keep(cut)
        histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
        runs = plan(histogram, capacity)
        rows = [(s, rank, rank + run.count, run.first - rank, offset) for run in runs for offset, (s, rank) in zip(np.cumsum([0] + [t for t, _ in run.items]).tolist(), run.items)]
        rows.sort()
        lengths, firsts, _, bases, offsets = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        top = max(histogram.values(), default=1) + 1
        keys = lengths * top + firsts

        buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS)) * 4
        dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
        sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases_of = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("ahead"))
        order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
        ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(bases_of, ["length", "bucket"])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
                at = np.searchsorted(keys, length * top + rank, "right") - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bases[at] + rank), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ahead")).cast("long").alias("rank")).mapInArrow(
            place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
        )

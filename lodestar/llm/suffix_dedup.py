"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every such
string holds an anchor: the position of its least K-byte hash (the leftmost, on ties), which
depends on the string alone. So only suffixes that start at anchors whose K bytes occur twice in
the corpus are sorted. Each carries the context of the strings that its anchor stands for.

1. Anchors of each document; K-byte hashes that occur once are dropped by a count and a join.
2. Each task sorts its anchors' suffixes into runs (equal ones become one), front-codes them (length
   of the prefix shared with the one before, and the rest) and cuts them at sampled splitters.
3. Each range merges its pieces of runs with a loser tree whose nodes hold common-prefix
   lengths, so prefixes known to be equal are never compared again.
4. In the merged order, suffixes that share K bytes are neighbours. Comparing their contexts gives
   the repeated strings, which go back to the runs' members and become spans of documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, discard, scope, written

LENGTH = 200
K = 24
#: Bytes of texts whose hashes are computed at once; the arrays take about a hundred times as much.
SLICE_BYTES = 1 << 18
#: Bytes of suffixes that a task sorts into one run, and that one range merges, about.
RUN_BYTES, RANGE_BYTES = 32 << 20, 12 << 20
#: Splitters that the driver holds, at most, and sampled keys for each. Beyond that a range is dealt further by a hash of its keys' K bytes.
SPLITTERS, SAMPLED = 16_384, 16

_u64 = np.uint64
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _u64(2) + _u64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _u64((1 << 24) - 1)
_powers_of: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    held = _powers_of.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), _u64(base))
        held[0] = 1
        held = _powers_of[base] = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def _claim(phase: str) -> None:
    """What one phase leaves in a worker goes as the next one starts."""
    claim(f"suffixes: {phase}", _powers_of.clear)


def gram_hashes(raw: np.ndarray, k: int = K) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes at each position."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(len(raw), _BASE), dtype=np.uint64, out=sums[1:])
    h = (sums[k:] - sums[:n]) * _powers(n, _INVERSE)
    h ^= h >> _u64(31)
    h *= _u64(0xBF58476D1CE4E5B9)
    h ^= h >> _u64(29)
    return h


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K):
    """For texts raw[start:end]: document index, anchor, first and last string start, hash, by anchor."""
    width = length - k + 1
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    if len(raw) < length:
        return none
    h = gram_hashes(raw, k)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # hash first, then place
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    valid = np.zeros(len(least) + 1, np.int8)
    fit = ends - starts >= length
    np.add.at(valid, starts[fit], 1)
    np.add.at(valid, ends[fit] - length + 1, -1)
    at = np.nonzero(np.cumsum(valid[:-1]))[0]
    if not len(at):
        return none
    place = (least[at] & _PLACE).astype(np.int64)
    first = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    lo = at[first]
    hi = at[np.concatenate([np.nonzero(first)[0][1:] - 1, [len(at) - 1]])]
    place = place[first]
    return np.searchsorted(starts, lo, "right") - 1, place, lo, hi, h[place]


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least `at`."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            m = min(len(x), len(y))
            diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return at + (m - (diff.bit_length() + 7) // 8 if diff else m)
        at += 64
    return n


class Run:
    """A front-coded sorted run. Equal strings are one entry."""

    @staticmethod
    def encode(keys: list[bytes], sizes: list[int], counts: list[int], numbers: list[int]) -> bytes:
        shared, rest, last = [], [], b""
        for key in keys:
            n = common_prefix(last, key)
            shared.append(n)
            rest.append(key[n:])
            last = key
        table = np.array([shared, list(map(len, rest)), sizes, counts, numbers], "<u4")
        return np.array([len(keys)], "<u4").tobytes() + table.tobytes() + b"".join(rest)

    @staticmethod
    def decode(blob: bytes) -> Iterator[tuple[bytes, int, int, int, int]]:
        """(key, prefix shared with the key before, size, count, number), in order."""
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        table = np.frombuffer(blob, "<u4", 5 * n, 4).reshape(5, n).tolist()
        at, last = 4 + 20 * n, b""
        for shared, size, *more in zip(*table):
            last = last[:shared] + blob[at : at + size]
            at += size
            yield (last, shared, *more)


def merge(runs: list[Iterator]) -> Iterator[tuple[bytes, int, int, int, int, int]]:
    """All runs' entries in order: (key, prefix shared with the entry before, size, count, number, run).

    A loser tree. Every stream's head holds the length of its common prefix with the last winner of
    its node; of two heads the one that shares more with the last output is the smaller, and
    only heads that share equally much are compared, from that length on.
    """
    m = len(runs)
    if not m:
        return
    size = 1
    while size < m:
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - m)
    shared = [0] * size
    tree = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's common prefix with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (x, y) if b is None else (y, x)
        p, q = shared[x], shared[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        n = common_prefix(a[0], b[0], p)
        if a[0][n : n + 1] <= b[0][n : n + 1]:
            shared[y] = n
            return x, y
        shared[x] = n
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if size > 1 else 0
    while heads[top] is not None:
        key, _, *more = heads[top]
        yield (key, shared[top], *more, top)
        heads[top] = next(runs[top], None)
        if heads[top] is not None:
            shared[top] = heads[top][1]
        node = (top + size) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


#: Ends a suffix within a key; UTF-8 never holds it. The bytes before the anchor follow, backwards.
END = b"\xff"


def repeated_offsets(group: list[tuple[bytes, bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For distinct contexts (suffix, reversed prefix, count): ranges of offsets whose strings repeat.

    Offset o stands for the string that starts o bytes before the anchor. A context's offsets go
    from length - len(suffix) to len(prefix).
    """
    low = [length - len(f) for f, _, _ in group]
    out: list[list[tuple[int, int]]] = [[(lo, len(p))] if n > 1 else [] for lo, (_, p, n) in zip(low, group)]
    if len(group) <= 8:
        for i, (f, p, n) in enumerate(group):
            for j in range(i):
                g, q, m = group[j]
                if n > 1 and m > 1:
                    continue
                a, b = max(low[i], low[j], length - common_prefix(f, g)), common_prefix(p, q)
                if a <= b:
                    if n == 1:
                        out[i].append((a, b))
                    if m == 1:
                        out[j].append((a, b))
        return out
    found: list[list[int]] = [[] for _ in group]
    for o in range(min(low), max(len(p) for _, p, _ in group) + 1):
        held: dict[bytes, int] = {}
        twice = set()
        keys = {}
        for i, (f, p, n) in enumerate(group):
            if low[i] <= o <= len(p):
                keys[i] = key = p[:o] + END + f[: length - o]
                if n > 1 or key in held:
                    twice.add(key)
                held[key] = i
        for i, key in keys.items():
            if key in twice and group[i][2] == 1:
                found[i].append(o)
    for i, offsets in enumerate(found):
        for o in offsets:
            if out[i] and out[i][-1][1] == o - 1:
                out[i][-1] = (out[i][-1][0], o)
            else:
                out[i].append((o, o))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' rows (d, th, text) and, by (d, th), the spans of bytes to remove.

    th is a hash of the text, so rows that repeat an id are told apart; equal rows have equal spans.
    Only spans is an intermediate that stays.
    """
    with scope() as held:
        k = min(K, length)
        base = bounded_batches(docs).select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        kind = base.schema["d"].dataType.simpleString()

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _claim("find")
            for batch in batches:
                texts, at = batch.column(2).cast(pa.large_binary()), 0
                sizes = texts.fill_null(b"")
                n_bytes = np.diff(np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, 8 * sizes.offset))
                while at < len(batch):
                    stop = max(at + 1, at + int(np.searchsorted(np.cumsum(n_bytes[at:]), SLICE_BYTES)))
                    part = [x or b"" for x in texts.slice(at, stop - at).to_pylist()]
                    # a text beyond the places that a packed minimum can tell apart is cut into overlapping pieces
                    for first, starts, ends, raw in _chunks(part, length):
                        doc, place, lo, hi, h = anchors(raw, starts, ends, length, k)
                        if len(doc):
                            off = first[doc] - starts[doc]
                            row = pa.array(at + doc)
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(row), batch.column(1).take(row), pa.array(place + off), pa.array((place - lo).astype(np.int16)), pa.array((place - hi).astype(np.int16)), pa.array(h.view(np.int64))],
                                names=["d", "th", "p", "before", "least", "h"],
                            )
                    at = stop

        found = written(base.where(F.octet_length("text") >= length).mapInArrow(find, f"d {kind}, th bigint, p bigint, before short, least short, h bigint"), "anchors")
        # written, so that the join has an exchange on either side and a common hash's rows can be split
        twice = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
        per_doc = written(found.join(twice, "h", "left_semi").groupBy("d", "th").agg(F.collect_set(F.struct("p", "before", "least")).alias("at")), "candidates")
        discard(found, twice)
        own = per_doc.withColumnsRenamed({"d": "d2", "th": "th2"})
        texts = base.join(own, base["d"].eqNullSafe(F.col("d2")) & (F.col("th") == F.col("th2"))).select("d", "th", "text", "at")
        total = per_doc.agg(F.sum(F.size("at"))).first()[0] or 0
        ranges = int(max(1, -(-total * 285 // RANGE_BYTES)))
        splitters: list[bytes] = []
        if ranges > 1:
            # all anchors of a hash sample of the documents: about SAMPLED keys for each splitter
            wanted = min(ranges, SPLITTERS)
            picked = texts.where(F.pmod(F.xxhash64("th"), F.lit(max(1, int(total // (SAMPLED * wanted))))) == 0).select("text", F.explode("at.p").alias("p"))
            sampled = picked.select(F.substring(F.col("text").cast("binary"), (F.col("p") + 1).cast("int"), F.lit(k)).alias("s")).toPandas()["s"]
            ordered = sorted(map(bytes, sampled))
            splitters = sorted({ordered[i * len(ordered) // wanted] for i in range(1, wanted)}) if ordered else []
        parts = -(-ranges // (len(splitters) + 1))

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of pieces of runs (range, run, blob), and rows of the runs' members (run, number, d, th, p)."""
            _claim("sort")
            task, turn, held, size = TaskContext.get().partitionId(), 0, [], 0
            cuts = [s[:k] for s in splitters]

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal turn, held, size
                run = task * 1_000_000 + turn
                turn, size = turn + 1, 0
                held.sort(key=lambda x: x[0])
                keys, sizes, counts, members = [], [], [], []
                for key, f, d, th, p in held:
                    if keys and keys[-1] == key:
                        counts[-1] += 1
                    else:
                        keys.append(key)
                        sizes.append(f)
                        counts.append(1)
                    members.append((run, len(keys) - 1, d, th, p))
                held = []
                edges = [0]
                for s in cuts:
                    a, b = edges[-1], len(keys)
                    while a < b:  # the first key whose K bytes are not below the splitter
                        m = (a + b) // 2
                        a, b = (m + 1, b) if keys[m][:k] < s else (a, m)
                    edges.append(a)
                edges.append(len(keys))
                for i in range(0, len(members), 50_000):
                    r, n, d, th, p = zip(*members[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.int64()), pa.array(r, pa.int64()), pa.nulls(len(r), pa.binary()), pa.array(n, pa.int32()), pa.array(d, id_type), pa.array(th, pa.int64()), pa.array(p, pa.int64())], names=names)
                members = []
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    dealt: dict[int, list[int]] = defaultdict(list)
                    for j in range(a, b):
                        dealt[zlib.crc32(keys[j][:k]) % parts if parts > 1 else 0].append(j)
                    for x, own in dealt.items():
                        blob = Run.encode([keys[j] for j in own], [sizes[j] for j in own], [counts[j] for j in own], own)
                        yield pa.RecordBatch.from_arrays([pa.array([i * parts + x], pa.int64()), pa.array([run], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)

            names = ["part", "run", "blob", "number", "d", "th", "p"]
            for batch in batches:
                id_type = batch.column(0).type
                for i in range(len(batch)):
                    d, th, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode()
                    for x in batch.column(3)[i].as_py():
                        p, before, least = x["p"], x["before"], x["least"]
                        suffix = raw[p : p - least + length]
                        key = suffix + END + raw[p - before : p][::-1]
                        held.append((key, len(suffix), d, th, p))
                        size += len(key)
                    if size >= RUN_BYTES:
                        yield from flush()
            if held:
                yield from flush()

        runs = written(texts.mapInArrow(sort, f"part bigint, run bigint, blob binary, number int, d {kind}, th bigint, p bigint"), "runs")

        def compare(part: pd.DataFrame) -> pd.DataFrame:
            _claim("compare")
            names = part["run"].tolist()
            out: list[tuple[int, int, int, int]] = []
            group: list[tuple[bytes, int, list[tuple[int, int]], int]] = []

            def settle() -> None:
                if len(group) > 1 or group and group[0][3] > 1:
                    contexts = [(key[:f], key[f + 1 :], n) for key, f, _, n in group]
                    for spans, (_, _, owners, _) in zip(repeated_offsets(contexts, length), group):
                        for a, b in _joined([(a, b + 1) for a, b in spans]):
                            out.extend((run, number, a, b - 1) for run, number in owners)

            for key, shared, f, count, number, run in merge([Run.decode(b) for b in part["blob"]]):
                if group and shared == len(key) == len(group[-1][0]):
                    last = group[-1]
                    last[2].append((names[run], number))
                    group[-1] = (last[0], last[1], last[2], last[3] + count)
                    continue
                if group and shared < k:
                    settle()
                    group = []
                group.append((key, f, [(names[run], number)], count))
            settle()
            return pd.DataFrame(out, columns=["run", "number", "o1", "o2"])

        hits = runs.where("part is not null").select("part", "run", "blob").groupBy("part").applyInPandas(compare, "run bigint, number int, o1 int, o2 int")
        members = runs.where("number is not null").select("run", "number", "d", "th", "p")
        spans = members.join(hits, ["run", "number"]).select("d", "th", (F.col("p") - F.col("o2")).alias("a"), (F.col("p") - F.col("o1") + length).alias("b"))
        spans = written(spans.groupBy("d", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
        held.keep(spans)
        return base, spans


PIECE = 1 << 18


def _chunks(texts: list[bytes], length: int):
    """The texts concatenated, long ones in pieces that overlap by length - 1: (offset in its text, start, end) and the bytes."""
    if len(texts) > 1 or len(texts[0]) <= PIECE:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        yield np.zeros(len(texts), np.int64), ends - sizes, ends, np.frombuffer(b"".join(texts), np.uint8)
        return
    text = texts[0]
    for at in range(0, len(text) - length + 1, PIECE):
        raw = np.frombuffer(text[at : at + PIECE + length - 1], np.uint8)
        yield np.array([at]), np.array([0]), np.array([len(raw)]), raw


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, the columns named in keep, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and kept_text of each row.

    kept_text is kept without the halves of characters that a cut left; null for a null text.

    Null text is empty. Documents shorter than `length` bytes lose nothing. Equal rows repeat each
    other. An empty table gives an empty result. Other columns are ignored.
    """
    keep = keep or []
    base, spans = repeated_spans(docs, length, id_col, text_col)
    own = spans.withColumnsRenamed({"d": "_d", "th": "_th"})
    rows = docs.select(F.struct(id_col, *keep).alias("_key"), F.col(text_col).alias("_text"))
    same = F.col(f"_key.{id_col}").eqNullSafe(F.col("_d")) & (F.xxhash64("_text") == F.col("_th"))
    rows = rows.join(own, same, "left").select("_key", "_text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claim("cut")
        for batch in batches:
            out = defaultdict(list)
            for text, spans_ in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                merged = _joined([(x["a"], x["b"]) for x in spans_.as_py() or ()])
                edges = [0, *[e for s in merged for e in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
                out["kept_text"].append(kept.decode("utf-8", "ignore") if text.is_valid else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()), pa.array(out["kept_text"], pa.string())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"],
            )

    key = rows.schema["_key"].dataType.simpleString()
    done = rows.mapInArrow(cut, f"key {key}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, kept_text string")
    return done.select("key.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")

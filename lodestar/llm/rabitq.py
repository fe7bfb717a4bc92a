"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector x is rotated by a random orthogonal matrix R and coded by the signs of Rx, one bit a
component. Stored once with the code: the factor f = <sign(Rx)/sqrt(d), Rx>, and Rx itself in
PLANES bit planes, rounded at random. <sign(Rx)/sqrt(d), Ry> / f is an unbiased estimate of <x, y>;
its product is popcounts of the code with y's planes. A pair whose cosine is t or more has an estimate of t - EPSILON
standard errors at least, but with negligible probability; the error is
sqrt((1 - t^2) (1 - f^2) / (d - 1)) / f, and the rounding's. Only pairs that reach this bound are recomputed exactly.

Candidates are pairs that share a label and, in one of T tables, b bits of the code (and of codes
of further rotations). b grows with the logarithm of the largest label's row count and T so that
a pair at the threshold is missed with probability MISS at most. Equal vectors are one class before
that, and a class counts with its size.

1. Codes of each class, written once; only (class, code, factor, planes) go to the tables' buckets.
2. Each bucket's pairs are estimated. A pair belongs to the first table it shares. Classes in a
   pair that the bounds leave open are listed by bucket, with the partners' places as bits.
3. These fetch their vectors and are recomputed bucket by bucket. Links are summed without being
   written; only a spanning forest of each bucket goes on to the components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, scope, written
from .vectors import valid_vectors

EPSILON = 5.0
MISS = 1e-4
BUCKET_ROWS = 48
#: A larger bucket is compared as pairs of chunks of about so many rows.
CHUNK_ROWS = 1_024
PLANES = 4
#: Pairs that are estimated at once.
PAIRS = 1 << 18

_u64 = np.uint64


def rotations(dim: int, count: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many rows."""
    bits = max(4, ceil(log2(max(rows / BUCKET_ROWS, 2))))
    share = 1 - acos(threshold) / pi
    return bits, ceil(log(MISS) / log(1 - share**bits))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(bits: np.ndarray) -> np.ndarray:
    """rows x components of 0 and 1 as rows x words."""
    rows, n = bits.shape
    wide = np.zeros((rows, -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


class Codes:
    """Codes of vectors of one length. Row: words of all rotations' signs, planes, and (factor, low, step)."""

    def __init__(self, dim: int, bits: int, tables: int):
        self.dim, self.bits, self.tables = dim, min(bits, dim), tables
        self.each = dim // self.bits
        self.words = -(-dim // 64)
        self.spins = -(-tables // self.each)
        self.spin = rotations(dim, self.spins)
        mask = np.zeros((tables, self.spins, self.words * 64), np.uint8)
        for t in range(tables):
            at = t % self.each * self.bits
            mask[t, t // self.each, at : at + self.bits] = 1
        self.masks = np.packbits(mask.reshape(tables, -1), axis=1, bitorder="little").view("<u8")
        self.kind = np.dtype([("signs", "<u8", (self.spins * self.words,)), ("planes", "<u8", (PLANES * self.words,)), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4")])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of kind for unit vectors, and rows x tables: the bits of each key."""
        out, keys = np.zeros(len(x), self.kind), []
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        for r, spin in enumerate(self.spin):
            turned = x @ spin.T
            signs = turned >= 0
            out["signs"][:, r * self.words : (r + 1) * self.words] = _packed(signs)
            keys += [signs[:, i * self.bits : (i + 1) * self.bits] @ weights for i in range(self.each)]
            if r == 0:
                out["factor"] = np.abs(turned).sum(1) / self.dim**0.5
                low, high = turned.min(1), turned.max(1)
                step = np.maximum((high - low) / (2**PLANES - 1), 1e-9)
                # rounded up or down at random, so that the mean is the value
                rng = np.random.default_rng(zlib.crc32(x.tobytes()))
                level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + rng.random(turned.shape)), 0, 2**PLANES - 1).astype(np.uint8)
                out["low"], out["step"] = low, step
                for j in range(PLANES):
                    out["planes"][:, j * self.words : (j + 1) * self.words] = _packed(level >> j & 1)
        return out, np.stack(keys[: self.tables], 1)

    def open_pairs(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the pairs rows[a], rows[b] can reach the threshold, by the code of a and the planes of b."""
        w, d = self.words, self.dim
        code = rows["signs"][:, :w]
        ones, sums = np.bitwise_count(code).sum(1).astype(np.float64), np.zeros(len(rows))
        for j in range(PLANES):
            sums += np.bitwise_count(rows["planes"][:, j * w : (j + 1) * w]).sum(1) * float(1 << j)
        shared = np.zeros(len(a))
        for j in range(PLANES):
            for i in range(w):
                shared += np.bitwise_count(code[a, i] & rows["planes"][b, j * w + i]) * float(1 << j)
        factor, low, step = (rows[c].astype(np.float64) for c in ("factor", "low", "step"))
        # sum of y over the code's ones, twice, less the sum of y
        product = (2 * (step[b] * shared + low[b] * ones[a]) - (step * sums + low * d)[b]) / d**0.5
        error = np.sqrt((1 - threshold**2) * np.maximum(0, 1 - factor**2) / max(1, d - 1))[a] + 0.5 * step[b]
        return product + EPSILON * error >= threshold * factor[a]

    def first_table(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Which of the pairs share no table before t."""
        out = np.ones(len(a), bool)
        differ = rows["signs"][a] ^ rows["signs"][b]
        for s in range(t):
            out &= ((differ & self.masks[s]) != 0).any(1)
        return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees, of all pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _vectors(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, all of one length, as float64."""
    own = column.take(pa.array(rows))
    return np.asarray(own.flatten(), np.float64).reshape(len(rows), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that rows whose first `keys` columns are equal are in one."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if len(held) < 4096:
            continue
        cols = [held.column(i).to_numpy() for i in range(keys)]
        same = np.ones(len(held), bool)
        for c in cols:
            same &= c == c[-1]
        cut = len(held) - int(same.sum())
        if cut:
            yield held.slice(0, cut).combine_chunks().to_batches()[0]
            held = held.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks().to_batches()[0]


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new group begins, and the number of rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([np.nonzero(new)[0], [len(new)]])


#: A block packs its table and the two chunks that it compares.
_CHUNK_BITS = 22


def near_duplicates(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Links are pairs of equal, non-null labels with cosine >= threshold in double precision.
    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label
    or id, link with nothing. Vectors of different lengths never link. Rows that repeat an id are a vector
    each and keep a row each. Extra columns are ignored; an empty table gives an empty result.
    """
    with scope() as held:
        valid = valid_vectors(table, id_col, vector_col, F.col(label_col).alias("label")).where("label is not null and id is not null")
        hashed = valid.select("id", F.xxhash64("label").alias("lh"), F.xxhash64("label", "v").alias("h1"), F.hash("v", "label").alias("h2"), "v")
        # equal vectors: one class, numbered as it is written and named by its smallest id
        classes = hashed.groupBy("lh", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        largest = classes.groupBy("lh", F.size("v").alias("dim")).count().agg(F.max("count")).first()[0]
        if largest is None:
            return table.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
        links, joined = _links(classes, *table_shape(largest, threshold), threshold)
        named = classes.select("lh", "h1", "h2", "least", "size", "node").join(links, "node", "left").join(joined, "node", "left")
        named = written(named.withColumn("group", F.coalesce("component", "node")), "named")
        smallest = written(named.groupBy("group").agg(F.min("least").alias("component_id")), "smallest")
        per_class = written(named.join(smallest, "group").select("lh", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "linked")
        held.keep(per_class)
    takes = F.col("label").isNotNull() & F.col("id").isNotNull()
    everyone = valid_vectors(table, id_col, vector_col, F.col(label_col).alias("label"), every=True)
    keys = [F.when(takes & F.col("v").isNotNull(), h).alias(name) for name, h in (("lh", F.xxhash64("label")), ("h1", F.xxhash64("label", "v")), ("h2", F.hash("v", "label")))]
    result = everyone.select("id", *keys).join(per_class, ["lh", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, bits: int, tables: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, n): the other rows that each class links with; (node, component) of the linked classes."""
    shapes: dict[int, Codes] = {}

    def codes_of(dim: int) -> Codes:
        if dim not in shapes:
            shapes[dim] = Codes(dim, bits, tables)
        return shapes[dim]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.asarray(column.value_lengths(), np.int64)
            for dim in np.unique(sizes).tolist():
                rows = np.nonzero(sizes == dim)[0]
                codes = codes_of(dim)
                out, keys = codes.encode(unit(_vectors(column, rows)))
                label = np.asarray(batch.column(1).take(pa.array(rows)))
                # the bucket: label, length, table and bits, mixed
                seed = (label.view(np.uint64) ^ _u64(dim * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[:, None] + np.arange(tables, dtype=np.uint64) * _u64(0xD1342543DE82EF95)
                mixed = (seed ^ seed >> _u64(29)) * _u64(0xBF58476D1CE4E5B9) + keys.astype(np.uint64)
                mixed = (mixed ^ mixed >> _u64(32)) * _u64(0x94D049BB133111EB)
                mixed ^= mixed >> _u64(31)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, mixed.size + 1, tables, dtype=np.int32)), pa.array(mixed.view(np.int64).ravel()))
                raw = out.tobytes()
                size = codes.kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()), pa.array(np.full(len(rows), dim, np.int32)), buckets],
                    names=["node", "code", "dim", "buckets"],
                )

    coded = written(classes.select("node", "lh", "v").mapInArrow(encode, "node bigint, code binary, dim int, buckets array<bigint>"), "codes")
    slots = coded.select("node", "code", "dim", F.posexplode("buckets").alias("t", "bucket"))
    hot = written(slots.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_ROWS).select("bucket", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks")), "hot")
    # a bucket of c chunks is compared as pairs of chunks; a row goes to the c pairs that its chunk is in
    placed = slots.join(hot, "bucket", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).cast("long")
    dealt = placed.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    block = (F.col("t").cast("long") * (1 << _CHUNK_BITS) + F.least("chunk", "other")) * (1 << _CHUNK_BITS) + F.greatest("chunk", "other")
    sent = dealt.select("bucket", block.alias("block"), "node", "dim", F.col("chunk").cast("int").alias("chunk"), "code")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of each block that are in an open pair: place in the block, and the later partners' places as bits."""
        for batch in _groups(batches, 2):
            bucket, block, node, dims, chunk_ = (np.asarray(batch.column(i)) for i in range(5))
            out: list[tuple[int, int, int, int, bytes]] = []
            # blocks of one length and table, so that their pairs are estimated together
            starts = _starts([bucket, block])
            shape = dims[starts[:-1]].astype(np.int64) << 32 | block[starts[:-1]] >> 2 * _CHUNK_BITS
            for kind in np.unique(shape).tolist():
                mine = np.nonzero(shape == kind)[0]
                dim, t = kind >> 32, kind & (1 << 32) - 1
                codes = codes_of(dim)
                at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in mine])
                at = at[dims[at] == dim]
                rows = np.frombuffer(b"".join(batch.column(5).take(pa.array(at)).to_pylist()), codes.kind)
                group = np.searchsorted(starts, at, "right")
                left = np.searchsorted(group, group, "right") - np.arange(len(at)) - 1  # rows after it in its block
                found: list[tuple[np.ndarray, np.ndarray]] = []
                live, step = np.nonzero(left >= 1)[0], 1
                todo: list[tuple[np.ndarray, np.ndarray]] = []
                size = 0

                def settle() -> None:
                    nonlocal todo, size
                    if size:
                        a, b = (np.concatenate(x) for x in zip(*todo))
                        likely = codes.open_pairs(rows, a, b, threshold)
                        a, b = a[likely], b[likely]
                        # a block of two chunks compares rows of different chunks only
                        single = (block[at[a]] >> _CHUNK_BITS & (1 << _CHUNK_BITS) - 1) == (block[at[a]] & (1 << _CHUNK_BITS) - 1)
                        keep = single | (chunk_[at[a]] != chunk_[at[b]])
                        a, b = a[keep], b[keep]
                        first = codes.first_table(rows, a, b, t)
                        found.append((a[first], b[first]))
                    todo, size = [], 0

                while len(live):
                    todo.append((live, live + step))
                    size += len(live)
                    if size >= PAIRS:
                        settle()
                    step += 1
                    live = live[left[live] >= step]
                settle()
                if not found:
                    continue
                a, b = (np.concatenate(x) for x in zip(*found))
                if not len(a):
                    continue
                some = np.unique(np.concatenate([a, b]))  # in block order
                g = group[some]
                place = np.arange(len(some)) - np.searchsorted(g, g, "left")
                pa_, pb = np.searchsorted(some, a), np.searchsorted(some, b)
                order = np.argsort(pa_, kind="stable")
                pa_, pb = pa_[order], place[pb[order]]
                cuts = np.searchsorted(pa_, np.arange(len(some) + 1))
                for i, x in enumerate(some.tolist()):
                    bits_ = np.zeros(0, np.uint8)
                    partners = pb[cuts[i] : cuts[i + 1]]
                    if len(partners):
                        bits_ = np.zeros(int(partners.max()) + 1, np.uint8)
                        bits_[partners] = 1
                    out.append((int(bucket[at[x]]), int(block[at[x]]), int(place[i]), int(node[at[x]]), np.packbits(bits_, bitorder="little").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "block", "place", "node", "partners"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, null, links) and (node, node, 0) of each block's forest."""
        for batch in _groups(batches, 2):
            bucket, block, place, node, size, label = (np.asarray(batch.column(i)) for i in (0, 1, 2, 3, 5, 6))
            starts = _starts([bucket, block])
            masks, vectors = batch.column(4).to_pylist(), batch.column(7)
            first: list[np.ndarray] = []
            second: list[np.ndarray] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                at = dict(zip(place[s:e].tolist(), range(s, e)))
                for i in range(s, e):
                    if masks[i]:
                        partners = np.nonzero(np.unpackbits(np.frombuffer(masks[i], np.uint8), bitorder="little"))[0]
                        second.append(np.array([at[p] for p in partners.tolist()], np.int64))
                        first.append(np.full(len(partners), i))
            if not first:
                continue
            a, b = np.concatenate(first), np.concatenate(second)
            lengths = np.asarray(vectors.value_lengths(), np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.asarray(vectors.flatten(), np.float64)
            good = np.zeros(len(a), bool)
            for dim in np.unique(lengths[a]).tolist():
                rows = np.nonzero(lengths == dim)[0]
                x = np.zeros((len(lengths), dim))
                x[rows] = unit(flat[offsets[rows][:, None] + np.arange(dim)])
                own = np.nonzero((lengths[a] == dim) & (lengths[b] == dim) & (label[a] == label[b]))[0]
                for k in range(0, len(own), PAIRS):
                    part = own[k : k + PAIRS]
                    good[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= threshold
            a, b = a[good], b[good]
            links = np.zeros(len(node), np.int64)
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            some = links > 0
            tree = np.array(_forest(node[a], node[b]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[some], tree[:, 0]])), pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(tree[:, 1])]), pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)]))],
                names=["a", "b", "n"],
            )

    open_ = sent.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    open_ = written(open_.mapInArrow(estimate, "bucket bigint, block bigint, place int, node bigint, partners binary"), "open")
    fetched = open_.join(classes.select("node", "size", "lh", "v"), "node").select("bucket", "block", "place", "node", "partners", "size", "lh", "v")
    fetched = fetched.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "place")
    found = written(fetched.mapInArrow(exact, "a bigint, b bigint, n bigint"), "links")
    linked = written(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts")
    return linked, written(components(found.where("b is not null")), "joined")

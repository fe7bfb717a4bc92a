"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, stars.

A document's shingle hashes are dealt into BINS bins by their high bits and each bin keeps its
least hash; an empty bin borrows from a bin that a universal hash of (bin, attempt) points to.
Bands of ROWS bins give buckets. Documents with equal shingle sets are one class before that.

In each bucket every member is paired with one centre only, so a bucket of n gives n - 1 pairs.
Pairs are confirmed on the full sets, and bands choose different centres. Buckets whose members
aren't in one component then are settled exactly: those of up to SMALL_BUCKET members by their
open pairs, the members of all larger ones by a prefix join, first of some sets of each component,
then of all that this leaves in different ones. For that a document's shingles
are put in one order for all, rarest first. Two linked documents' first common shingle is then
among the first seventh of the smaller set and the first quarter of the larger, and enough
shingles follow it in both; only pairs that meet there and can still be linked are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, components, discard, is_empty, scope, written

WORDS, PERCENT = 5, 75
BINS, ROWS = 128, 4
SLICE_BYTES = 1 << 20
#: A mixed bucket of up to so many members is settled by its open pairs, a constant number for each; a larger one by the prefix join.
SMALL_BUCKET = 8
#: Sets of each component, about, that the prefix join tries first. What they don't settle meets all sets in its second pass.
TRIED_FIRST = 64

_u64 = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    h = (h ^ (h >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _u64(27))) * _u64(0x94D049BB133111EB)
    return h ^ (h >> _u64(31))


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _u64(2) + _u64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ORDER = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * _u64(2) + _u64(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, _u64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word of a byte string."""
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    power = _powers(len(raw) + 1, _BASE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:-1], dtype=np.uint64)])
    # the sum over a word, moved to the power that it would have at place 0
    return _mix((sums[end] - sums[start]) * _powers(len(raw) + 1, _INVERSE)[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= SLICE_BYTES):
            size += len(raw[stop]) + 1
            stop += 1
        ends = np.cumsum([len(r) + 1 for r in raw[at:stop]])
        h, start = word_hashes(np.frombuffer(b"\n".join([*raw[at:stop], b""]), np.uint8))
        cuts = np.searchsorted(start, np.concatenate([[0], ends]))
        with np.errstate(over="ignore"):
            parts = [h * k for k in _ORDER]
            m = len(h) - words + 1
            full = sum((parts[i][i : i + m] for i in range(1, words)), parts[0][:m].copy()) if m > 0 else h[:0]
            full = _mix(full)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                n = b - a
                if n >= words:
                    own = np.unique(full[a : b - words + 1])
                elif n:
                    own = _mix(sum((parts[i][a + i : a + i + 1] for i in range(1, n)), parts[0][a : a + 1].copy()) + _u64(n))
                else:
                    own = h[:0]
                out.append(own)
        at = stop
    return out


def _probes(bins: int, attempts: int = 2048) -> np.ndarray:
    """The bin that each bin borrows from, attempt by attempt: a universal hash of both."""
    b, a = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(attempts, dtype=np.uint64), indexing="ij")
    return (_mix(b * _u64(0xD6E8FEB86659FD93) + a + _u64(1)) >> _u64(40)).astype(np.int64) % bins


_PROBES = _probes(BINS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation minima with optimal densification: documents x BINS. Empty sets: zeros."""
    n, shift = len(sets), _u64(64 - (BINS - 1).bit_length())
    sig, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            which = (s >> shift).astype(np.int64)  # the set is sorted, so the first of a bin is its least
            first = np.concatenate([[True], which[1:] != which[:-1]])
            sig[i, which[first]] = s[first]
            full[i, which[first]] = True
    own = full.copy()
    some = np.nonzero(own.any(1))[0]
    for attempt in range(_PROBES.shape[1]):
        r, c = np.nonzero(~full[some])
        if not len(r):
            break
        r = some[r]
        source = _PROBES[c, attempt]
        good = own[r, source]
        sig[r[good], c[good]] = sig[r[good], source[good]]
        full[r[good], c[good]] = True
        some = np.unique(r[~good])
        if not len(some):
            break
    return sig


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    sig = signatures(sets).reshape(len(sets), BINS // ROWS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(BINS // ROWS, dtype=np.uint64)[None, :] * _u64(0xA0761D6478BD642F) + _u64(1)
        for i in range(ROWS):
            key = _mix(key ^ sig[:, :, i] + _u64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(part.column(2).to_pylist())
                keys = band_keys(sets)
                with np.errstate(over="ignore"):
                    h1 = [int(np.add.reduce(s, dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                    h2 = [int(np.bitwise_xor.reduce(_mix(s + _u64(77))).view(np.int64)) if len(s) else 0 for s in sets]
                bands = [k if len(s) else None for k, s in zip(keys, sets)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "th", "n", "h1", "h2", "bands"],
                )

    return docs.mapInArrow(run, "id bigint, th bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.mapInArrow(run, "node bigint, hashes array<bigint>")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of wanted (node, id, th). Both grow with the corpus: neither is broadcast."""
    keys = wanted.select("node", F.col("id").alias("_id"), F.col("th").alias("_th")).hint("merge")
    texts = docs.join(keys, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th")))
    return written(_sets(texts.select("node", "text").dropDuplicates(["node"])), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets meet the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    return written(both.where(100 * common >= PERCENT * (F.size("ha") + F.size("hb") - common)).select("a", "b"), "links")


def _size_class(n: str) -> Column:
    """Sizes that allow a link are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.lit(log(100 / PERCENT))).cast("int")


def _unsettled(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of opened (node, n, component) in different components: all that meet the threshold are among them.

    A shingle that only one component holds can't be common to a pair: it comes before all others.
    Of a linked pair's sets the smaller one, x, has 2 * PERCENT / (100 + PERCENT) of itself from
    their first common shingle on, so only such places are an index; sets without one are never met
    as the smaller. Components meet at a shingle before their members do, so a component's own pairs are never made.
    """
    with scope() as held:
        own = written(sets.join(opened, "node"), "opened-sets")
        tokens = own.select("node", "n", "component", F.explode("hashes").alias("t"))
        shared = written(tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("t", "df"), "shared")
        ordered = tokens.join(shared, "t").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
        alone = F.col("n") - F.size("s")
        quarter = F.floor(F.col("n") * (100 - PERCENT) / 100)
        first = ordered.withColumn("alone", alone).where(F.col("alone") <= quarter).withColumn("s", F.slice("s", 1, (quarter + 1 - F.col("alone")).cast("int")))
        # rest: the shingles from this one on
        placed = first.select("node", "n", "component", "alone", F.posexplode("s").alias("at", "x"))
        large = written(placed.select("node", "n", "component", F.col("x.t").alias("t"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), _size_class("n").alias("size")), "first")
        small = large.where((100 + PERCENT) * F.col("rest") >= 2 * PERCENT * F.col("n")).withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
        side = lambda df, x: df.select("t", "size", *[F.col(c).alias(f"{c}{x}") for c in df.columns if c not in ("t", "size")])
        # common / (x + y - common) >= PERCENT / 100
        enough = (F.col("nx") <= F.col("ny")) & ((100 + PERCENT) * F.least("restx", "resty") >= PERCENT * (F.col("nx") + F.col("ny")))
        # a component's sets of one size that have the shingle, by their best place
        best = lambda df: df.groupBy("t", "size", "component", "n").agg(F.max("rest").alias("rest"), F.count("*").alias("many"))
        meet = side(best(small), "x").join(side(best(large), "y"), ["t", "size"]).where((F.col("componentx") != F.col("componenty")) & enough)
        meet = written(meet.drop("restx", "resty"), "meet")
        # the side with fewer members first, so that a large group's are met once, by those that may be linked
        x, y = (["t", "size", f"component{i}", f"n{i}"] for i in "xy")
        fewer = F.col("manyx") <= F.col("manyy")
        one = meet.where(fewer).join(side(small, "x"), x).join(side(large, "y"), y).where(enough)
        other = meet.where(~fewer).join(side(large, "y"), y).join(side(small, "x"), x).where(enough)
        pairs = written(one.select(*_pair("nodex", "nodey")).unionAll(other.select(*_pair("nodex", "nodey"))).distinct(), "pairs")
        held.keep(pairs)
        return pairs


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _alike(x: str, y: str) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _links(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, component) of the linked classes; None if there are no links."""
    slots = classes.select("node", "n", F.explode("bands").alias("key"))
    # the centre differs from band to band: the least hash of (node, key)
    least = F.min(F.struct(F.xxhash64("node", "key").alias("x"), F.col("node").alias("c"), F.col("n").alias("nc")))
    centres = written(slots.groupBy("key").agg(F.count("*").alias("m"), least.alias("low")).where("m > 1").select("key", "m", "low.c", "low.nc"), "centres")
    members = written(slots.join(centres, "key"), "buckets")
    discard(centres)
    tried = written(members.where((F.col("node") != F.col("c")) & _alike("n", "nc")).select(*_pair("node", "c")).distinct(), "tried")
    named = classes.select("node", "rep.id", "rep.th")
    sets = _full_sets(docs, written(members.select("node").distinct().join(named, "node"), "wanted"))
    links = _confirmed(tried, sets)
    joined = written(components(links), "joined") if not is_empty(links) else None
    for most in (TRIED_FIRST, None):
        opened, small = _open(members, joined)
        if most is not None:
            # a set that links with some of a component's is settled by these; all of the others meet in the second pass
            many = opened.groupBy("component").agg(F.ceil(F.count("*") / most).alias("parts"))
            opened = opened.join(many, "component").where(F.pmod(F.xxhash64("node"), "parts") == 0).drop("parts")
            pairs = _unsettled(opened, sets)
        else:
            pairs = _unsettled(opened, sets).unionAll(small)
        rest = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        more = _confirmed(rest, sets)
        tried, links = tried.unionAll(rest), links.unionAll(more)
        if not is_empty(more):
            joined = written(components(links), "joined")
    return joined


def _open(members: DataFrame, joined: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of buckets that more than one component is in: the sets (node, n, component) of large ones, and the open pairs of small ones."""
    now = members.select("key", "m", "node", "n")
    if joined is not None:
        now = now.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        now = now.withColumn("component", F.col("node"))
    now = written(now, "placed")
    mixed = written(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed")
    left, right = (now.where(F.col("m") <= SMALL_BUCKET).join(mixed, "key").select("key", F.col("node").alias(i), F.col("n").alias(f"n{i}"), F.col("component").alias(f"c{i}")) for i in "xy")
    small = left.join(right, "key").where((F.col("cx") < F.col("cy")) & _alike("nx", "ny")).select(*_pair("x", "y"))
    opened = written(now.where(F.col("m") > SMALL_BUCKET).join(mixed, "key").select("node", "n", "component").distinct(), "opened")
    return opened, small


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs, then text_hash and group.

    Words are runs of bytes other than ASCII white space, A-Z as a-z. A text of fewer than five
    words is one shingle; one without words, or null, has none and links with nothing; so does
    a null id. Rows that repeat an id are judged each by its own text: each has the smallest id
    that its own text reaches. group tells the components apart where ids can't (null where a row
    links with nothing), and text_hash is xxhash64 of the text. Other columns are ignored. An
    empty table gives an empty result.
    """
    with scope() as held:
        base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        feats = written(_features(base), "shingles")
        live = feats.where("n > 0 and id is not null")
        # numbered as they are written, so that a class has a number of its own even if ids repeat
        classes = live.groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("bands").alias("bands"))
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        joined = _links(classes, base)
        names = classes.select("n", "h1", "h2", "node", F.col("rep.id").alias("least"))
        if joined is None:
            names = names.select("n", "h1", "h2", F.col("node").alias("group"), F.col("least").alias("component"))
        else:
            named = written(names.join(joined, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "named")
            smallest = written(named.groupBy("group").agg(F.min("least").alias("component")), "smallest")
            names = named.drop("least").join(smallest, "group").select("n", "h1", "h2", "group", "component")
        names = written(names, "names")
        held.keep(feats, names)
        linked = (F.col("n") > 0) & F.col("id").isNotNull()
        out = feats.select("id", "th", "n", "h1", "h2").join(names, ["n", "h1", "h2"], "left").withColumn("component", F.when(linked, F.col("component")).otherwise(F.col("id")))
        return out.select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.col("component").alias("component_id"),
            F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
            F.col("th").alias("text_hash"),
            F.when(linked, F.col("group")).alias("group"),
        )

import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import line_spread, minhash, queries, rabitq, suffix_dedup
from lodestar.llm.ivfpq import search


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for d, r in enumerate(raw):
        for i in range(len(r) - length + 1):
            seen.setdefault(r[i : i + length], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for r, g in zip(raw, gone):
        edges = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
        out.append((len(r), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~g])).hexdigest()))
    return out


def shared_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    passages = [prose(60) for _ in range(6)]
    texts: list = [None, "", "short", "ab" * 400, "a" * 700, "a" * 199, "b" * 200, "b" * 200]
    for _ in range(n):
        parts = [prose(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : rng.randint(a, len(p))], prose(rng.randint(0, 20))]
        text = " ".join(parts)
        texts.append(text)
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            texts.append(text[:at] + "#" + text[at:])
        if rng.random() < 0.1:
            texts.append(text)
    return texts


def test_suffix_dedup_against_brute_force(spark, no_docs, monkeypatch):
    for seed, length in ((1, 200), (2, 60)):
        texts = shared_texts(seed)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
        if seed == 2:  # many runs and ranges
            monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 20_000)
            monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 20_000)
        got = suffix_dedup.remove_repeats(docs, length).orderBy("doc_id").collect()
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_repeats(texts, length)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_large_groups_of_contexts():
    rng = random.Random(4)
    group = sorted({("".join(rng.choices("ab", k=rng.randint(4, 9))).encode(), "".join(rng.choices("ab", k=rng.randint(0, 6))).encode()) for _ in range(40)})
    group = [("c" * 3 + f.decode()).encode()[:10] for f, _ in group], [p for _, p in group]
    contexts = [(f, p, 1) for f, p in dict.fromkeys(zip(*group))]
    got = suffix_dedup.repeated_offsets(contexts, 10)
    for i, (f, p, _) in enumerate(contexts):
        want = {o for o in range(10 - len(f), len(p) + 1) for j, (g, q, _) in enumerate(contexts) if i != j and 10 - len(g) <= o <= len(q) and p[:o] == q[:o] and f[: 10 - o] == g[: 10 - o]}
        assert {o for a, b in got[i] for o in range(a, b + 1)} == want


def test_loser_tree_orders_and_measures():
    rng = random.Random(8)
    streams = [sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 30))}) for _ in range(7)]
    blobs = [suffix_dedup.Run.encode(s, [0] * len(s), [1] * len(s), list(range(len(s)))) for s in streams]
    got = list(suffix_dedup.merge([suffix_dedup.Run.decode(b) for b in blobs]))
    assert [g[0] for g in got] == sorted(x for s in streams for x in s)
    for a, b in zip(got, got[1:]):
        assert b[1] == suffix_dedup.common_prefix(a[0], b[0])


def shingles(text):
    words = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(n, linked):
    name = list(range(n))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        name[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(n)]


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "a b c d", "A B C D", "a b c d e", "a b c d e "]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(5, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else "\n".join(own))
    rng.shuffle(texts)
    return texts


def test_minhash_against_brute_force(spark, no_docs):
    for seed in (1, 2, 3):
        texts = near_texts(seed)
        sets = [shingles(t) for t in texts]
        linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        want = brute_components(len(texts), linked)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
        got = minhash.near_duplicates(docs).orderBy("doc_id").collect()
        assert [r["n_shingles"] for r in got] == list(map(len, sets))
        assert [r["component_id"] for r in got] == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_minhash_pairs_that_share_a_long_passage(spark):
    rng = random.Random(6)
    fresh = (f"w{i}" for i in range(100_000))
    take = lambda k: [next(fresh) for _ in range(k)]
    passage, texts = take(100), []
    for _ in range(250):
        own = take(4)
        texts += [" ".join(passage + own + take(14 + rng.randint(0, 1))) for _ in range(2)]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = minhash.near_duplicates(docs).orderBy("doc_id").collect()
    assert len(linked) == 250
    assert [r["component_id"] for r in got] == brute_components(len(texts), linked)


def test_minhash_odd_rows(odd_docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd_docs).collect()}
    assert got[None]["n_shingles"] == 1 and got[0]["n_shingles"] == 0 and got[10]["component_id"] == 6 and not got[10]["kept"]


def test_line_spread(spark, odd_docs, no_docs):
    rows = [(i, f"own line {i}\n  All rights reserved \n\nfour sites {i // 4}", f"s{i % 7}") for i in range(28)] + [(100, None, "s1"), (101, "All rights reserved", None), (None, "All rights reserved", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in line_spread.drop_boilerplate(docs, 5).collect()}
    assert got[3]["text"] == "own line 3\n\nfour sites 0" and got[3]["n_lines"] == 3 and got[3]["n_removed"] == 1
    assert got[100]["text"] is None and got[100]["n_lines"] == 0
    assert got[101]["text"] == "" and sum(r["n_removed"] for r in got.values()) == 29
    assert line_spread.drop_boilerplate(odd_docs).count() == odd_docs.count()
    assert line_spread.drop_boilerplate(no_docs).count() == 0


def spread_rows():
    """Lines on five sites: two whose sketches are equal and one without a name; each space around them; a null id first."""
    lines = [("All rights reserved", s) for s in ("", "site21346", "site3540", "a", "b")]
    for i, space in enumerate(" \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000" + "\t\r\x0b\u0085\u200b\ufeff"):
        lines += [(f"line {i}", s) for s in "abc"] + [(f"{space}line {i}{space}\n{space}", s) for s in "de"]
    rows = [(i, f"own {i}\n{line}", site) for i, (line, site) in enumerate(lines)]
    return [(None, "line 0\nAll rights reserved", "a"), *rows, (len(rows), "All rights reserved", None), (len(rows) + 1, "", "a")]


def test_line_spread_against_its_sql(spark, tmp_path):
    docs = spark.createDataFrame(spread_rows(), "doc_id bigint, text string, source string")
    estimate = docs.where("doc_id < 5").selectExpr("hll_sketch_estimate(hll_sketch_agg(source, 12)) e").first()["e"]
    assert estimate == 3, "five sites, of which the sketch sees three"
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op8_line_spread(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(line_spread.SQL).fetchall()))


def test_line_spread_query_counts_in_the_text_that_is_left(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([*spread_rows(), (1000, None, "a")], "doc_id bigint, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    want = sorted(line_spread.drop_boilerplate(docs).select("doc_id", "n_lines", "n_removed").collect(), key=key)
    assert sorted(queries.op8_line_spread(spark, str(tmp_path)).collect(), key=key) == want
    cut = line_spread.drop_boilerplate
    monkeypatch.setattr(line_spread, "drop_boilerplate", lambda docs: cut(docs).withColumn("text", F.lit(None).cast("string")))
    assert all(r["n_removed"] == r["n_lines"] for r in queries.op8_line_spread(spark, str(tmp_path)).collect())


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 8, dim))
    x = (base[rng.integers(0, len(base), n)] + 0.25 * rng.standard_normal((n, dim))).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(i, x[i].tolist(), int(rng.integers(0, 3)) if i % 11 else None) for i in range(n)]
    rows[10:15] = [(10, None, 1), (11, [0.0] * dim, 1), (12, [float("nan")] * dim, 1), (13, [None] * dim, 1), (14, [float("inf")] * dim, 1)]
    return rows


def test_rabitq_against_brute_force(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    for seed in (1, 2):
        rows = vectors(seed)
        ok = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, lab in rows if lab is not None and not 10 <= i < 15}
        label = {r[0]: r[2] for r in rows}
        linked = [(a, b) for a in ok for b in ok if b < a and label[a] == label[b] and ok[a] @ ok[b] >= 0.93]
        want, count = brute_components(len(rows), linked), np.bincount([x for p in linked for x in p], minlength=len(rows))
        got = rabitq.near_duplicates(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()
        assert [r["component_id"] for r in got] == want
        assert [r["n_links"] for r in got] == count.tolist()
    assert rabitq.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_ivfpq_recall(spark):
    import pyspark.sql.functions as F

    schema = "vec_id bigint, embedding array<float>, label int"
    rows = vectors(3, 3000)
    valid = [(i, np.array(v, np.float64)) for i, v, _ in rows if not 10 <= i < 15]
    x, ids = np.stack([v for _, v in valid]), np.array([i for i, _ in valid])
    got: dict = {}
    for r in search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11))
        hit += len({ids[b] for b in best} & {v for _, v, _ in mine})
        total += 10
        assert all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in mine)
    assert hit >= 0.9 * total
    assert search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = search(spark.createDataFrame(rows[:4], schema), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]


def test_suffix_dedup_long_texts_ids_and_columns(spark, monkeypatch):
    """Texts beyond a piece, rows that repeat an id, clashing columns, and more ranges than splitters."""
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=900))
    texts = ["".join(rng.choices("xyz", k=5000)) + passage + "".join(rng.choices("uvw", k=7000)), passage, "".join(rng.choices("ijk", k=3000)) + passage[100:700], "q" * 250, "q" * 250]
    for name, value in (("PIECE", 2048), ("SLICE_BYTES", 1024), ("RUN_BYTES", 2_000), ("RANGE_BYTES", 2_000), ("SPLITTERS", 2)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [(i // 2, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_removed int, spans string").repartition(3)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, 60).collect())
    assert got == sorted(brute_repeats(texts, 60))


def test_minhash_templates(spark):
    """Many documents of one template: only pairs that share their own words, too, are linked."""
    for seed, n in ((1, 80), (2, 80), (3, 300)):
        rng = random.Random(seed)
        fresh = (f"w{i}" for i in range(1_000_000))
        template = [next(fresh) for _ in range(400)]
        texts = []
        for _ in range(n):
            own = [next(fresh) for _ in range(100)]
            texts += [" ".join(template + own), " ".join(template + own[:48] + [next(fresh) for _ in range(52)])]
        order = list(range(len(texts)))
        rng.shuffle(order)
        want = brute_components(len(texts), [(order.index(2 * i), order.index(2 * i + 1)) for i in range(n)])
        docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id bigint, text string").repartition(3)
        got = minhash.near_duplicates(docs).orderBy("doc_id").collect()
        assert [r["component_id"] for r in got] == want
    sets = [shingles(texts[order[i]]) for i in range(40)]
    linked = {(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked == {(a, b) for a in range(40) for b in range(a) if order[a] // 2 == order[b] // 2}


def test_minhash_repeated_ids(spark):
    a, x = ("a b c d e f g h", "s t u v w x y z")
    docs = spark.createDataFrame([(1, a, 0), (1, x, 0), (2, x, 0), (3, a, 0), (3, a, 0), (None, a, 0)], "doc_id bigint, text string, component int")
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]


def test_rabitq_odd_rows(spark):
    """Repeated ids, two lengths, doubles that floats can't tell apart, and clashing columns."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 24))
    rows = [(i, (base[i % 6] + 0.05 * rng.standard_normal(24)).tolist(), "a", 1) for i in range(60)]
    rows += [(i, (base[i % 6][:10] + 0.05 * rng.standard_normal(10)).tolist(), "a", 1) for i in range(60, 90)]
    rows += [(7, rows[8][1], "a", 1), (7, rows[7][1], "a", 1), (7, None, "a", 1), (None, rows[7][1], "a", 1), (95, rows[0][1], None, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string, size int").repartition(3)
    got = rabitq.near_duplicates(table).collect()
    assert len(got) == len(rows)
    live = [i for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and r[2] is not None]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in live}
    linked = [(a, b) for a in live for b in live if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    count, root = [0] * len(rows), brute_components(len(rows), linked)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    least: dict = {}
    for i in live:
        least[root[i]] = min(rows[i][0], least.get(root[i], 1 << 60))
    want = [(r[0], count[i], least.get(root[i], r[0]) if i in unit else r[0]) for i, r in enumerate(rows)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r["vec_id"], r["n_links"], r["component_id"]) for r in got))) == sorted(map(key, want))
    t = 0.93
    close = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [t + 1e-12, (1 - (t + 1e-12) ** 2) ** 0.5], 1), (3, [t - 1e-9, -((1 - (t - 1e-9) ** 2) ** 0.5)], 1)], "vec_id bigint, embedding array<double>, label int")
    assert [r["n_links"] for r in rabitq.near_duplicates(close).orderBy("vec_id").collect()] == [1, 1, 0]


def test_rabitq_codes_settle_most_pairs():
    """The estimate is unbiased, its bound never loses a link, and few other pairs are left open."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((300, 64))
    x = rabitq.unit(np.concatenate([base, base + 0.25 * rng.standard_normal(base.shape)]))
    codes = rabitq.Codes(64, 7, 18)
    rows, keys = codes.encode(x)
    a, b = (k.ravel() for k in np.meshgrid(np.arange(600), np.arange(600), indexing="ij"))
    a, b = a[a < b], b[a < b]
    cosine = np.einsum("ij,ij->i", x[a], x[b])
    left = codes.open_pairs(rows, a, b, 0.93)
    assert left[cosine >= 0.93].all() and left[cosine < 0.93].mean() < 0.02
    t = 5
    shared = (keys[a, :t] == keys[b, :t]).any(1)
    assert (codes.first_table(rows, a, b, t) == ~shared).all()


def brute_nearest(vectors, ids, query, k=10):
    own = min((v for v, i in zip(vectors, ids) if i == query), key=tuple)
    found = sorted((float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), i) for v, i in zip(vectors, ids) if i != query and len(v) == len(own))
    return found[:k]


def test_ivfpq_skips_lists_and_finds_the_nearest(spark):
    import pyspark.sql.functions as F

    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 24))
    x[::3] = x[0]  # a third are copies
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got: dict = {}
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    for r in search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for q in range(0, 20_000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len(set(best.tolist()) & {v for _, v in got[q]})
    assert hit >= 0.9 * 2000
    few = search(table, F.col("vec_id") % 100 == 0, probes=3)
    assert few.count() > 0


def test_ivfpq_odd_rows(spark):
    """Repeated ids, ties, doubles, two lengths and clashing columns, against all distances."""
    import pyspark.sql.functions as F

    rng = np.random.default_rng(4)
    vectors = [*rng.standard_normal((80, 6)).tolist(), *rng.standard_normal((30, 3)).tolist()]
    ids = list(range(110))
    vectors += [vectors[0], vectors[0], [x + 5.0 for x in vectors[0]], vectors[3], vectors[81]]
    ids += [0, 200, 0, 201, 202]
    rows = [*zip(ids, vectors, range(len(ids))), (None, vectors[0], 0), (300, None, 0), (400, [0.0] * 6, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int").repartition(3)
    got: dict = {}
    for r in search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == {0, 100, 200}
    for q in (0, 100, 200):
        want = brute_nearest(vectors, ids, q)
        assert [(s, v) for _, s, v in sorted(got[q])] == [(s, v) for s, v in want] and [r for r, *_ in sorted(got[q])] == list(range(1, 11))


def test_suffix_dedup_memory_of_hashes():
    import tracemalloc

    raw = np.random.default_rng(1).integers(97, 123, suffix_dedup.SLICE_BYTES).astype(np.uint8)
    suffix_dedup._powers_of.clear()
    tracemalloc.start()
    suffix_dedup.anchors(raw, np.array([0]), np.array([len(raw)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing
from lodestar.llm.bpe_automaton import Automaton, AutomatonEncoder, bpe_round_trip
from lodestar.llm.queries import tokenizer_path
from lodestar.llm.token_files import ShardReader, read_token_files, write_token_files
from lodestar.llm.units import library_encoder


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed=5):
    rng = random.Random(seed)
    bits = ["a", "e", "th", " ", " ", "  ", "\n", "\t", "ing", "é", "日", "1", "23", ".", "'s", "'", " ", "　", "<|endoftext|>", "\r\n"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(n)]


def test_units_equal_the_library(tok):
    import pyarrow as pa

    texts = random_texts(3000) + [None]
    ids, ends = library_encoder(tokenizer_path())(pa.array(texts))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == ids_of(tok, t), t


def test_automaton_equals_the_library(tok):
    enc = AutomatonEncoder(tokenizer_path())
    for t in random_texts(3000, 9):
        assert np.frombuffer(enc.encode_text(t), "<u4").tolist() == ids_of(tok, t), t


def test_small_automaton_by_hand():
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab", "bb"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "b")]

    def plain(word):
        word = list(word)
        for u, v in merges:
            i = 0
            while i < len(word) - 1:
                if (word[i], word[i + 1]) == (u, v):
                    word[i : i + 2] = [u + v]
                i += 1
        return [vocab[x] for x in word]

    automaton = Automaton(vocab, merges)
    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert automaton.encode_word(word.encode()) == plain(word), word
            assert automaton.decode(automaton.encode_word(word.encode())) == word.encode()


def test_round_trip(spark, tok, odd_docs, no_docs):
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe_round_trip(odd_docs, tokenizer_path()).collect()}
    rows = odd_docs.collect()
    for r in rows:
        ids = ids_of(tok, r["text"])
        mine = got[r["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert mine["n_tokens"] == len(ids) and mine["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe_round_trip(no_docs, tokenizer_path()).count() == 0


def test_files(spark, tok, odd_docs, no_docs):
    manifest = write_token_files(odd_docs, tokenizer_path())
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    start, want = 0, []
    for r in rows:
        ids = [*ids_of(tok, r["text"]), 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in read_token_files(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    # one document alone, and a damaged frame
    path = manifest.orderBy("shard").first()["path"]
    reader = ShardReader(path)
    some = int(reader.ids[-1])
    assert [x.tolist() for x in reader.document(some)] == [[*ids_of(tok, next(r["text"] for r in rows if r["doc_id"] == some)), 0]]
    reader.table[0, 2] ^= 1
    with pytest.raises(ValueError):
        list(reader.frames(0, 1))
    assert read_token_files(write_token_files(no_docs, tokenizer_path())).count() == 0


def test_packing(spark, tok, odd_docs, no_docs):
    capacity = 64
    rows = packing.pack(odd_docs, tokenizer_path(), capacity=capacity).collect()
    held: dict = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for r in odd_docs.collect():
        ids = np.array([*ids_of(tok, r["text"]), 0], "<u4")
        mine = sorted((x["start"], x["length"], x["piece"], x["ids_crc32"]) for x in rows if x["doc_id"] == r["doc_id"])
        assert sum(x[1] for x in mine) == len(ids) and [x[2] for x in mine] == list(range(len(mine)))
        assert all(x[1] == capacity for x in mine[1:])
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) for s, n, _, crc in mine)
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_plan_places_everything_once():
    rng = random.Random(3)
    for trial in range(6):
        histogram = {s: rng.randint(1, 400) for s in rng.sample(range(1, 2049), 300)}
        runs = packing.plan(histogram, 2048)
        placed: dict = {}
        for run in runs:
            assert sum(s for s, _ in run.items) == 2048 - run.free and run.free >= 0
            for s, rank in run.items:
                placed.setdefault(s, []).append((rank, rank + run.count))
        for s, n in histogram.items():
            spans = sorted(placed[s])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        spans = sorted((r.first, r.first + r.count) for r in runs)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        least = max(sum(s * n for s, n in histogram.items()) / 2048, sum(n for s, n in histogram.items() if s > 1024))
        assert spans[-1][1] <= 1.08 * least + 2


def test_shards_follow_the_bytes(spark, tok, monkeypatch):
    from lodestar.llm import token_files

    least = -(1 << 63)
    rows = [(i, "some words here " * (i % 40)) for i in range(200)] + [(None, "null"), (None, "id"), (least, "least"), (7, "again"), (300, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    plan = write_token_files(docs, tokenizer_path())
    monkeypatch.setattr(token_files, "READ_BYTES", 1_000)
    for manifest in (plan, write_token_files(docs.withColumn("start", docs["doc_id"]), tokenizer_path())):
        got = sorted((tuple(r) for r in read_token_files(manifest).collect()), key=lambda r: r[1])
        want = [(i, [*ids_of(tok, t), 0]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]) if r[0] is not None else (False, 0, r[1]))]
        assert [(r[0], r[2], r[3]) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
        assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([len(x) for _, x in want])[:-1]]).tolist()
    first = ShardReader(plan.orderBy("shard").first()["path"])
    assert [x.tolist() for x in first.document(least)] == [[*ids_of(tok, "least"), 0]]


def test_a_writer_rolls_over(tmp_path):
    from lodestar.llm.token_files import ShardWriter

    writer = ShardWriter(str(tmp_path / "a.zst"), 0)
    writer.add(None, b"\0\0\0\0")
    writer.add(5, b"\1\0\0\0" * 3)
    writer.close()
    reader = ShardReader(str(tmp_path / "a.zst"))
    assert reader.null.tolist() == [True, False] and reader.n_tokens.tolist() == [1, 3] and list(reader.frames(1, 2)) == [b"\1\0\0\0" * 3]


def test_long_texts_in_slices(tok, monkeypatch):
    import pyarrow as pa

    from lodestar.llm import minhash, units

    texts = random_texts(200, 13) + ["word " * 5000, None, "", "tail"]
    whole_sets = [s.tolist() for s in minhash.shingle_sets(texts)]
    monkeypatch.setattr(units, "SLICE_BYTES", 100)
    monkeypatch.setattr(minhash, "SLICE_BYTES", 100)
    assert [s.tolist() for s in minhash.shingle_sets(texts)] == whole_sets
    column, got = pa.array(texts), []
    encode = library_encoder(tokenizer_path())
    for at, part in units.slices(column):
        assert at == len(got)
        ids, ends = encode(part)
        got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [ids_of(tok, t) for t in texts]


def test_encoder_memory():
    """Four MiB of texts without a repeated word: the slices and the cache stay small."""
    import tracemalloc

    import pyarrow as pa

    from lodestar.llm import units

    words = iter(range(10**9))
    texts = pa.array([" ".join(f"{next(words):x}" for _ in range(2000)) for _ in range(350)])
    encode = units.UnitEncoder(lambda strings: [b"\0\0\0\0"] * len(strings))
    tracemalloc.start()
    for _, part in units.slices(texts):
        encode(part)
    peak = tracemalloc.get_traced_memory()[1]
    encode.cache.clear()
    tracemalloc.stop()
    assert peak < 100 << 20


def test_encoder_cache_limit():
    import pyarrow as pa

    from lodestar.llm import units

    encode = library_encoder(tokenizer_path())
    for k in range(2):
        encode(pa.array([" ".join(f"{i:x}" for i in range(k * 250_000, (k + 1) * 250_000))]))
    assert 100_000 < len(encode.cache) <= units.LIBRARY_UNITS <= 200_000

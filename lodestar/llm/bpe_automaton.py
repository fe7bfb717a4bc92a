"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads token arcs and accepts exactly the token sequences that byte-level BPE can
return. It starts as one state with a loop for each byte. Each merge (u, v) -> w adds a gadget:
arcs labelled u get a copy of their target without its v arc, and wherever u could be read, w can
be read, leading where v led. All arcs of one label share a target, so a state is a chain of
removals (merge, label), and the arcs that a removal takes away (the label and those built on its
left later) are one interval of a post-order of the left-component forest. A transition is thus
a lookup in a state's interval table.

Every prefix of a word has one tokenization, so each position of a word is reached by one arc.
Encoding is one forward pass: a suffix automaton over the labels names the arcs that can end at
a byte, longest first, and the first that its state allows is taken. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, claim
from .units import UnitEncoder, slices

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_CACHE = 400_000


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        letters, self.special = byte_letters(), special or {}
        label = {t: bytes(letters[c] for c in t) for t in vocab if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for t, b in label.items():
            self.labels[vocab[t]] = b
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        self.arc = {b: vocab[t] for t, b in label.items()}
        self._suffixes()
        pairs = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        self.born = {w: m for m, (_, _, w) in enumerate(pairs)}
        self.built: dict[int, list[int]] = {}  # on its left, in order of birth
        for u, _, w in pairs:
            self.built.setdefault(u, []).append(w)
        self._number({w for _, _, w in pairs})
        # the gadgets: target[t] is the state that arcs t lead to; a state is (parent, merge, label removed)
        target = [0] * size
        self.states: list[tuple[int, int, int]] = [(-1, -1, -1)]
        self.made_in = {}
        for m, (u, v, w) in enumerate(pairs):
            before = target[u]
            target[w] = before if u == v else target[v]
            self.made_in[w] = (before, u, v)
            self.states.append((before, m, v))
            target[u] = len(self.states) - 1
        self.target, self.tables, self.steps, self.live = target, {}, {}, {}

    def _suffixes(self) -> None:
        """go, fail: an Aho-Corasick automaton over the labels. out: by node, the longest arc that ends there; shorter: by arc, the next one."""
        self.size = list(map(len, self.labels))
        go, fail, out, depth = {}, [0], [-1], [[]]
        for label, t in self.arc.items():
            node = 0
            for k, b in enumerate(label):
                key = node << 8 | b
                node = go.get(key, 0)
                if not node:
                    node = go[key] = len(out)
                    out.append(-1)
                    fail.append(0)
                    while len(depth) <= k + 1:
                        depth.append([])
                    depth[k + 1].append((node, key >> 8, b))
            out[node] = t
        self.shorter = [-1] * len(self.size)
        for level in depth[1:]:
            for node, parent, b in level:
                at = fail[parent]
                found = go.get(at << 8 | b, 0) if parent else 0
                while not found and at:
                    at = fail[at]
                    found = go.get(at << 8 | b, 0)
                fail[node] = found
                if out[node] < 0:
                    out[node] = out[found]
                else:
                    self.shorter[out[node]] = out[found]
        self.go, self.fail, self.out = go, fail, out

    def _number(self, merged: set[int]) -> None:
        """Post-order of the forest in which w = u + v is a child of u; low: least number below."""
        self.post, self.low, at = {}, {}, 0
        for root in (i for i in self.arc.values() if i not in merged):
            stack = [(root, False)]
            while stack:
                t, done = stack.pop()
                if not done:
                    self.low[t] = -1
                    stack.append((t, True))
                    stack += [(w, False) for w in reversed(self.built.get(t, ()))]
                else:
                    kids = self.built.get(t, ())
                    self.low[t] = self.low[kids[0]] if kids else at
                    self.post[t] = at
                    at += 1

    def _table(self, state: int) -> tuple[array, array]:
        """The removed intervals of a state, joined and in order; its nearest known ancestor's and the removals since."""
        if state not in self.tables:
            found, s = [], state
            while s > 0 and s not in self.tables:
                parent, m, x = self.states[s]
                kids = self.built.get(x, ())
                k = bisect_right([self.born[y] for y in kids], m - 1) if kids else 0
                found.append((self.low[kids[k]] if k < len(kids) else self.post[x], self.post[x]))
                s = parent
            if s > 0:
                found += zip(*self.tables[s])
            starts, ends = array("i"), array("i")
            for a, b in sorted(found):
                if ends and a <= ends[-1] + 1:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
            self.tables[state] = starts, ends
        return self.tables[state]

    def _has(self, state: int, t: int) -> bool:
        starts, ends = self._table(state)
        i = bisect_right(starts, self.post[t]) - 1
        return i < 0 or ends[i] < self.post[t]

    def alive(self, t: int) -> bool:
        """False for an arc whose merge could never happen, or that is built on such an arc."""
        if t not in self.live:
            made = self.made_in.get(t)
            self.live[t] = made is None or (self.alive(made[1]) and self.alive(made[2]) and self._has(made[0], made[2]))
        return self.live[t]

    def step(self, last: int, t: int) -> bool:
        """Whether the arc t leaves the state that the arc last leads to (last < 0: the start)."""
        key = last << 20 | t
        got = self.steps.get(key) if last >= 0 else self.live.get(t)
        if got is None:
            got = self.alive(t) and (last < 0 or self._has(self.target[last], t))
            if last >= 0 and len(self.steps) < 2_000_000:
                self.steps[key] = got
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        whole = self.arc.get(word)
        if whole is not None and self.alive(whole):
            return [whole]
        go, fail, out, shorter, size, steps, step = self.go.get, self.fail, self.out, self.shorter, self.size, self.steps.get, self.step
        by, node, end = [-1], 0, 0
        for b in word:
            found = go(node << 8 | b, 0)
            while not found and node:
                node = fail[node]
                found = go(node << 8 | b, 0)
            node, end = found, end + 1
            t = out[node]
            while t >= 0:
                last = by[end - size[t]]
                ok = steps(last << 20 | t) if last >= 0 else None
                if ok or ok is None and step(last, t):
                    break
                t = shorter[t]
            by.append(t)
        ids = []
        while end > 0:
            ids.append(by[end])
            end -= size[by[end]]
        return ids[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


class AutomatonEncoder:
    """Pre-splits, encodes and decodes whole texts; keeps the ids of frequent words."""

    def __init__(self, path: str):
        self.automaton = Automaton.from_file(path)
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, bytes] = {}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.automaton.special)) + ")").split if self.automaton.special else lambda s: [s]
        self.encoder = UnitEncoder(lambda strings: list(map(self.encode_text, strings)))

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = pack(self.automaton.encode_word(word.encode()))
            if len(self.words) < WORD_CACHE:
                self.words[word] = got
        return got

    def encode_text(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(np.array([self.automaton.special[part]], "<u4").tobytes())
            else:
                out += map(self._word, self.split(part))
        return b"".join(out)


_shared: dict[str, AutomatonEncoder] = {}


def shared_encoder(path: str) -> AutomatonEncoder:
    """One automaton a worker and file, so that its tables outlive a task."""
    claim("automaton", _shared.clear)
    if path not in _shared:
        _shared[path] = AutomatonEncoder(path)
    return _shared[path]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256.

    One row a document, in no order; nothing is shuffled. A null or empty text has no ids and
    decodes to the empty string. Repeated rows and null ids are kept as they are; other columns
    are ignored. tokenizer_path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(tokenizer_path)
        for batch in batches:
            for at, texts in slices(batch.column(1), 4):
                ids, ends = enc.encoder(texts)
                rows = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    own = ids[a:b].tolist()
                    text = enc.automaton.decode(own).decode("utf-8", "replace")
                    rows.append((b - a, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                n, x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

"""Encoding of whole texts by way of their distinct space-delimited units.

A byte-level BPE encoder never merges across its pre-split words, and a space that follows a
non-space always starts such a word. So a text can be cut at spaces, each distinct unit encoded
once per batch, and the ids gathered by numpy. Texts in which white space surrounds a space
(where the cut could change the split) are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim

#: Fixed value: the white space of Unicode, as RE2 writes it.
SPACE = r"\x09-\x0d \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNSAFE = rf"[{SPACE}] (?:[{SPACE}]|$)|<\|endoftext\|>"
#: Bytes of texts that are encoded at once. A worker's memory beside the cache is some tens of times as much.
SLICE_BYTES = 1 << 20
#: Units that a worker's cache holds at most; fewer where encoding is fast.
CACHE_UNITS, LIBRARY_UNITS = 400_000, 200_000
#: Units that the library encodes in one call; each starts with a space, so none changes the others' ids.
JOINED = 500
SPECIAL = "<|endoftext|>"


def slices(texts: pa.Array, times: int = 1) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about `times` SLICE_BYTES, with the first one's index."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + times * SLICE_BYTES, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of ranges first[i] .. first[i] + count[i]."""
    total = int(count.sum())
    step = np.ones(total, np.int64)
    live = count > 0
    first, count = first[live], count[live]
    if total == 0:
        return step
    step[0] = first[0]
    at = np.cumsum(count)[:-1]
    step[at] = first[1:] - (first[:-1] + count[:-1]) + 1
    return np.cumsum(step)


class UnitEncoder:
    """encode: a list of strings to the ids of each as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHE_UNITS):
        self.encode, self.most, self.cache = encode, most, {}

    def _known(self, keys: list[str]) -> list[bytes]:
        """The ids of each key as little-endian bytes."""
        cache = self.cache
        got = list(map(cache.get, keys))
        new = [k for k, v in zip(keys, got) if v is None]
        if new:
            made = self.encode(new)
            fresh = dict(zip(new, made))
            got = [fresh[k] if v is None else v for k, v in zip(keys, got)]
            cache.update(islice(fresh.items(), self.most - len(cache)))
        return got

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's ids (one more than there are texts)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(~whole), texts, ""), " ")
        offsets = np.asarray(cut.offsets, np.int64)
        flat = cut.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes, units = np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()
        first = offsets[:-1]
        # the first unit of a text has no space before it; a text that needs it is one unit
        heads = [t if w else h for t, w, h in zip(texts.to_pylist() if whole.any() else [None] * len(texts), whole, flat.take(pa.array(first)).to_pylist())]
        seen = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        codes[first] = len(units) + np.fromiter((seen[h] for h in heads), np.int64, len(heads))
        ids = self._known([" " + u for u in units]) + self._known(list(seen))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        book = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(size) - size
        count = size[codes]
        out = book[spread(start[codes], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return out, ends[offsets]


def library_encoder(path: str) -> UnitEncoder:
    """An encoder over the tokenizers library and its file, without truncation or padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    vocab = tok.get_vocab()
    n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    n_bytes[list(vocab.values())] = list(map(len, vocab))  # byte-level: a character stands for each byte

    def encode(strings: list[str]) -> list[bytes]:
        out: list = [None] * len(strings)
        safe = [i for i, s in enumerate(strings) if len(s) > 1 and s[0] == " " and not s[1].isspace() and not s[-1].isspace() and SPECIAL not in s]
        chunks = [safe[i : i + JOINED] for i in range(0, len(safe), JOINED)]
        joined = tok.encode_batch_fast(["".join([strings[i] for i in c]) for c in chunks], add_special_tokens=False)
        for chunk, got in zip(chunks, joined):
            ids = np.array(got.ids, "<u4")
            raw, ends = ids.tobytes(), np.cumsum([len(strings[i].encode()) for i in chunk])
            cuts = (4 * np.searchsorted(np.cumsum(n_bytes[ids]), ends) + 4).tolist()
            for i, a, b in zip(chunk, [0, *cuts], cuts):
                out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, got in zip(rest, tok.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(got.ids, "<u4").tobytes()
        return out

    return UnitEncoder(encode, LIBRARY_UNITS)


_encoders: dict[str, UnitEncoder] = {}


def shared_library_encoder(path: str) -> UnitEncoder:
    """One encoder a worker and file, so that its cache outlives a task."""
    claim("units", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = library_encoder(path)
    return _encoders[path]

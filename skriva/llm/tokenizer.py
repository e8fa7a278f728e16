"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is a token as a whole, all distinct
pre-tokens of a group of texts at once; the few others are merged on a linked list of bytes with a heap of candidate
merges, and remembered in a bounded table of the worker.

The vocabulary has a fixed size, so the driver reads it once and sends it to every task. One pass over the rows, no
shuffle, whole texts.

Null and empty texts give an empty list. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Where the vocabulary files are by default; a parameter everywhere.
VOCABULARY_DIR = "/opt/tokenizers"
# Fixed value: how this vocabulary's texts are split before encoding.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the texts that are worked on at once; one longer text goes alone.
AT_ONCE = 1_000_000
#: Merged pre-tokens that a worker remembers.
REMEMBERED = 200_000


class PerfectHash:
    """A minimal perfect hash by displacement: n keys, n slots, one probe.

    Keys are bucketed by one half of a 64-bit hash. Buckets of several keys get the first displacement that sends all of
    them to free slots; the remaining single keys take the remaining slots, written as negative displacements.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // 4)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) != len(keys):
            raise ValueError("keys repeat")
        bucket = self._bucket(h)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys = np.empty(n, object)
        self.index = np.full(n, -1, np.int32)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.append(0, np.cumsum(sizes))
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size < 2:
                break
            members = order[starts[b] : starts[b + 1]]
            d = 0
            while True:
                # Many displacements are tried at once.
                ds = np.arange(d, d + 64, dtype=np.uint64)
                slots = self._slot(h[members][None, :], ds[:, None])
                ok = free[slots].all(1)
                if size > 1:
                    s = np.sort(slots, 1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    k = int(ok.argmax())
                    self._put(slots[k], members, keys, free)
                    self.shift[b] = d + k
                    break
                d += 64
        spare = np.flatnonzero(free)
        singles = [b for b in range(self.buckets) if sizes[b] == 1]
        for slot, b in zip(spare, singles, strict=False):
            self._put(np.array([slot]), order[starts[b] : starts[b] + 1], keys, free)
            self.shift[b] = -int(slot) - 1

    def _put(self, slots: np.ndarray, members: np.ndarray, keys: list[bytes], free: np.ndarray) -> None:
        free[slots] = False
        self.index[slots] = members
        for s, m in zip(slots, members, strict=True):
            self.keys[s] = keys[m]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Of each word its place among the keys, or -1."""
        if not words:
            return np.empty(0, np.int32)
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        d = self.shift[self._bucket(h)]
        slot = np.where(d < 0, -d - 1, self._slot(h, d.clip(0).astype(np.uint64)))
        asked = np.empty(len(words), object)
        asked[:] = words
        return np.where(self.keys[slot] == asked, self.index[slot], -1)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a pre-token: always the merge of least rank, leftmost first, until none is left."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(word[i : i + 2])) is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        # Stale unless the pieces [a, b) and [b, c) still stand.
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, -1
        if c < n:
            before[c] = a
            d = end[c]
            if (r := ranks.get(word[a:d])) is not None:
                heapq.heappush(heap, (r, a, c, d))
        if (p := before[a]) >= 0 and (r := ranks.get(word[p:c])) is not None:
            heapq.heappush(heap, (r, p, a, c))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        words = list(ranks)
        self.hash = PerfectHash(words)
        self.ids = np.array([ranks[w] for w in words], np.int32)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[bytes, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "pattern": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.pattern = regex.compile(PATTERN)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the place where each text's ids end."""
        find = self.pattern.findall
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, s in enumerate(texts):
            if s:
                found = find(s)
                counts[i] = len(found)
                words += found
        if not words:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        place: dict[str, int] = {}
        codes = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        raw = [w.encode("utf-8", "surrogatepass") for w in place]
        at = self.hash.lookup(raw)
        single = np.where(at >= 0, self.ids[at], 0)
        lengths = np.ones(len(raw), np.int64)
        start = np.arange(len(raw))
        extra, base = [], len(raw)
        for k in np.flatnonzero(at < 0):
            w = raw[k]
            ids = self.known.get(w)
            if ids is None:
                ids = merge(w, self.ranks)
                if len(w) <= 256:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[w] = ids
            start[k], lengths[k] = base + len(extra), len(ids)
            extra += ids
        flat = np.concatenate([single, np.array(extra, np.int32)]).astype(np.int32)
        n = lengths[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1])]
        return out, np.append(0, ends)[np.cumsum(counts)]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """The vocabulary of `path`: a line per token, its bytes in base64 and its id."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _in_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    begin, chars = 0, 0
    for i, s in enumerate(texts):
        n = len(s or "")
        if chars and chars + n > AT_ONCE:
            yield texts[begin:i]
            begin, chars = i, 0
        chars += n
    if begin < len(texts):
        yield texts[begin:]


def encode_column(df: DataFrame, key: str, text: str, path: str = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """key, ids (list of INT): one row per row."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            done = 0
            for group in _in_groups(batch.column(1).to_pylist()):
                ids, ends = encoder.encode(group)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), lists], names=[key, "ids"])
                done += len(group)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"
    return df.select(key, text).mapInArrow(encode, schema)

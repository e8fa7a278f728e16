"""Evaluation texts leaking into training text.

A document leaks an item if they share a run of `WORDS` words (items in Japanese: of `CHARS` characters). Runs are
shingles, so this is containment search of short items in long documents: by MinHash in size classes, then verified.

A MinHash of a whole long document can't show one run of it, so the sketch of a text is the set of the MinHashes of its
runs: the least hash among the parts of a run (`PARTS` words or characters in a row). Neighbouring runs mostly have the same
least part, so a sketch holds about a fifth of a text's hashes; and equal runs have the same MinHash, so a text that holds
a run of an item always holds its MinHash: nothing is missed. One least part serves at most as many runs as a run has
parts. A document that holds m of an item's runs therefore holds at least m / parts of its sketch, rounded up.

Items are put into classes by their number of runs, in powers of two. Each class has a bitmap of the sketches of its items,
and the least overlap of sketches that the smallest item of the class may have: `min_share` of its runs, one at least.
Documents are looked through once, by words and by characters in the same pass. In a task a document is a candidate in the
classes whose overlap it reaches, and of a candidate those runs go on whose MinHash is in the class's bitmap and whose own
hash is in the bitmap of all items' runs. Both bitmaps have a fixed size. What goes on is joined with the items on hash
and text, which is the exact check of containment.

Null texts, and texts and items shorter than a run, share nothing. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.session import cut

WORDS, CHARS = 12, 20
#: Words or characters in a part of a run.
PARTS = {"w": 4, "c": 8}
#: Bits of the bitmap of a class of sketches, and of the one of all runs, as powers of two: 0.5 MB and 8 MB.
SKETCH_BITS, RUN_BITS = 22, 26
#: Characters of the texts that are worked on at once; one longer text goes alone.
AT_ONCE = 500_000

_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[\W_]+")
_BASE = {"w": np.uint64(0x9E3779B97F4A7C15), "c": np.uint64(0xC2B2AE3D27D4EB4F)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(codes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """The hash of every k codes in a row."""
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * base + codes[i : i + n]
    return _mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, in log2(width) passes."""
    n = len(h) - width + 1
    step, m = 1, h
    while 2 * step <= width:
        m = np.minimum(m[: len(m) - step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[width - step : width - step + n])


class Runs:
    """The runs of k words ('w') or characters ('c') of many texts: place, MinHash and text each belongs to."""

    def __init__(self, texts: list[str], mode: str, k: int):
        self.mode, self.k = mode, k
        low = [s.lower() for s in texts]
        if mode == "w":
            found = [_WORD.findall(s) for s in low]
            self.units: list | str = [w for f in found for w in f]
            place: dict[str, int] = {}
            at = np.fromiter((place.setdefault(w, len(place)) for w in self.units), np.int64, len(self.units))
            hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in place], np.uint64)
            self.codes = hashes[at] if len(at) else np.empty(0, np.uint64)
        else:
            found = [_OTHER.sub("", s) for s in low]
            self.units = "".join(found)
            self.codes = np.frombuffer(self.units.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        part = min(PARTS[mode], k)
        if len(self.codes) < k:
            self.at, self.minhash, self.owner = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        least = sliding_min(_rolled(self.codes, part, _BASE[mode]), k - part + 1)
        self.at = np.flatnonzero(owner[: len(least)] == owner[k - 1 :])
        self.minhash, self.owner = least[self.at], owner[self.at]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the whole runs at these places."""
        h = np.zeros(len(at), np.uint64)
        for i in range(self.k):
            h = h * _BASE[self.mode] + self.codes[at + i]
        return _mix(h)

    def texts(self, at: np.ndarray) -> list[str]:
        return [" ".join(self.units[i : i + self.k]) if self.mode == "w" else self.units[i : i + self.k] for i in at.tolist()]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    texts = batch.column(1).to_pylist()
    begin, chars = 0, 0
    for i, s in enumerate(texts):
        if chars and chars + len(s) > AT_ONCE:
            yield batch.column(0).slice(begin, i - begin), texts[begin:i]
            begin, chars = i, 0
        chars += len(s)
    if begin < len(texts):
        yield batch.column(0).slice(begin), texts[begin:]


def item_runs(items: DataFrame, key: str, text: str, mode: str, k: int) -> DataFrame:
    """key, mode, minhash, hash, run: the distinct runs of each item."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _groups(batch):
                runs = Runs(texts, mode, k)
                yield pa.RecordBatch.from_pydict(
                    {
                        key: keys.take(pa.array(runs.owner, pa.int64())),
                        "mode": pa.array([mode] * len(runs.at), pa.string()),
                        "minhash": pa.array(runs.minhash.view(np.int64)),
                        "hash": pa.array(runs.hashes(runs.at).view(np.int64)),
                        "run": pa.array(runs.texts(runs.at), pa.string()),
                    }
                )

    schema = f"`{key}` {items.schema[key].dataType.simpleString()}, mode string, minhash bigint, hash bigint, run string"
    return items.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(go, schema).distinct()


def _bitmaps(rows: DataFrame, group: list[str], column: str, bits: int) -> dict[tuple, np.ndarray]:
    """A bitmap of 2^bits bits of the column's hashes per group. Its words are put together by the cluster."""
    low = f"({column} & {2**bits - 1})"
    words = rows.select(*group, F.expr(f"shiftright({low}, 6)").alias("_i"), F.expr(f"shiftleft(1L, cast({low} & 63 AS int))").alias("_b"))
    rows_ = words.groupBy(*group, "_i").agg(F.bit_or("_b").alias("_b")).toArrow()
    keys = list(zip(*(rows_.column(g).to_pylist() for g in group), strict=True)) if group else [()] * rows_.num_rows
    place, word = rows_.column("_i").to_numpy(), rows_.column("_b").to_numpy()
    out = {}
    for k in set(keys):
        mine = np.fromiter((x == k for x in keys), bool, len(keys))
        out[k] = np.zeros(2 ** (bits - 6), np.int64)
        out[k][place[mine]] = word[mine]
    return {k: v.view(np.uint8) for k, v in out.items()}


def _has(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    low = h & np.uint64(2**bits - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def candidate_runs(documents: DataFrame, key: str, text: str, sizes: dict[str, int], sketches: dict[tuple, np.ndarray], least: dict[tuple, int], whole: np.ndarray) -> DataFrame:
    """key, mode, hash, run: of each document those runs that may be an item's; one pass for both modes.

    `sketches` and `least`: per (mode, class) the bitmap, and how many of its MinHashes a candidate must hold.
    """
    shared = documents.sparkSession.sparkContext.broadcast((sketches, whole))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, all_runs = shared.value
        for batch in batches:
            for keys, texts in _groups(batch):
                for mode, k in sizes.items():
                    own = [(c, m) for c, m in maps.items() if c[0] == mode]
                    if not own:
                        continue
                    runs = Runs(texts, mode, k)
                    wanted = np.zeros(len(runs.at), bool)
                    for c, m in own:
                        hit = np.flatnonzero(_has(m, runs.minhash, SKETCH_BITS))
                        if least[c] > 1 and len(hit):
                            # Different MinHashes of the class per document.
                            pairs = np.unique(np.stack([runs.owner[hit].astype(np.uint64), runs.minhash[hit]]), axis=1)
                            enough = np.bincount(pairs[0].astype(np.int64), minlength=len(texts)) >= least[c]
                            hit = hit[enough[runs.owner[hit]]]
                        wanted[hit] = True
                    at, owner = runs.at[wanted], runs.owner[wanted]
                    h = runs.hashes(at)
                    good = _has(all_runs, h, RUN_BITS)
                    at, owner, h = at[good], owner[good], h[good]
                    if not len(at):
                        continue
                    _, first = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            key: keys.take(pa.array(owner[first], pa.int64())),
                            "mode": pa.array([mode] * len(first), pa.string()),
                            "hash": pa.array(h[first].view(np.int64)),
                            "run": pa.array(runs.texts(at[first]), pa.string()),
                        }
                    )

    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, mode string, hash bigint, run string"
    return documents.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(go, schema)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "passage",
    lang: str = "lang",
    min_share: float = 0.0,
    words: int = WORDS,
    chars: int = CHARS,
) -> DataFrame:
    """doc, item, shared (distinct shared runs), containment (share of the item's runs): one row per leak.

    An overlap counts from one run, or from `min_share` of the item's runs if that is more.
    """
    japanese = F.coalesce(F.lower(F.col(lang)).startswith("ja"), F.lit(False))
    lengths = {"w": words, "c": chars}
    found = item_runs(items.where(~japanese), item_key, item_text, "w", words).unionByName(item_runs(items.where(japanese), item_key, item_text, "c", chars))
    runs = cut(found)
    sizes = runs.groupBy(item_key).agg(F.countDistinct("hash", "run").alias("size"))
    classed = runs.join(sizes.select(item_key, F.floor(F.log2("size")).cast("int").alias("class")), item_key)
    sketches = _bitmaps(classed, ["mode", "class"], "minhash", SKETCH_BITS)
    whole = _bitmaps(runs, [], "hash", RUN_BITS).get((), np.zeros(2 ** (RUN_BITS - 3), np.uint8))
    least = {}
    for mode, c in sketches:
        parts = lengths[mode] - min(PARTS[mode], lengths[mode]) + 1
        needed = max(1, int(np.ceil(2**c * min_share - 1e-9)))
        least[mode, c] = -(-needed // parts)
    hits = candidate_runs(documents, doc_key, doc_text, lengths, sketches, least, whole)
    item = runs.select(item_key, "mode", "hash", "run").distinct()
    counts = hits.join(item, ["mode", "hash", "run"]).select(doc_key, item_key, "hash", "run").distinct().groupBy(doc_key, item_key).agg(F.count("*").alias("shared"))
    leaks = counts.join(sizes, item_key).where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.col("size") * min_share)))
    return leaks.select(doc_key, item_key, "shared", (F.col("shared") / F.col("size")).alias("containment"))

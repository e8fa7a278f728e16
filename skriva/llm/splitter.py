"""Splitting oversized items at natural boundaries, with overlap.

Every place where a text may be cut is a boundary with a level: 4 before a paragraph or heading, 3 after a line, 2 after
a sentence, 1 after a word or an ideograph, 0 inside a long run without any of these. From each boundary the piece that
would follow a cut there is fixed: it starts up to `overlap` tokens before it and ends at its farthest legal successor,
the last boundary within the limit, of the highest level that still leaves the piece half full. All greedy cuts then
follow by pointer doubling: the successor table is squared until it no longer changes, and the set of reached
boundaries grows by each power.

Tokens are one per ideograph and a quarter, rounded up, for all other characters, so `tokens(a, b) <= n` exactly if
the weight between a and b (4 per ideograph, 1 per other) is at most 4n: a prefix sum and binary searches do.

The tables of many texts are joined into one in each task and squared together. There is no shuffle: rows under the
limit stay in the JVM, and only oversized ones go to Python.

Null and empty bodies and blank ones within the limit give no piece; a blank one over it is cut like any other text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import is_blank, within_tokens

LIMIT, OVERLAP = 400, 40
#: Characters whose tables are worked on at once in a task; one longer text goes alone.
AT_ONCE = 500_000

# Ranges of characters that are one token each.
_IDEOGRAPHS = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0xAC00, 0xD7AF))
_SPACES = np.array([9, 11, 12, 32, 0x1C, 0x1D, 0x1E, 0x1F, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], np.uint32)
_BREAKS = np.array([10, 13, 0x85, 0x2028, 0x2029], np.uint32)
_STOPS = np.array([0x3002, 0xFF01, 0xFF1F, 0xFF0E, 0x2026], np.uint32)
_MARKS = np.array([ord(c) for c in ".!?"], np.uint32)
#: Marks that belong to the character before them: no cut goes there.
_JOINED = ((0x300, 0x36F), (0x3099, 0x309A), (0x200D, 0x200D), (0xFE00, 0xFE0F), (0x1F3FB, 0x1F3FF), (0x20D0, 0x20FF), (0xDC00, 0xDFFF))


def _within(c: np.ndarray, ranges: tuple) -> np.ndarray:
    out = np.zeros(len(c), bool)
    for a, b in ranges:
        out |= (c >= a) & (c <= b)
    return out


def _levels(c: np.ndarray, ideograph: np.ndarray) -> np.ndarray:
    """The level of a cut before each character, -1 where none is allowed; the first place counts as a paragraph."""
    n = len(c)
    at = np.arange(n)
    space, brk = np.isin(c, _SPACES), np.isin(c, _BREAKS)
    prev, prev_space, prev_brk, prev_cjk = np.roll(c, 1), np.roll(space, 1), np.roll(brk, 1), np.roll(ideograph, 1)
    level = np.full(n, -1, np.int8)
    level[prev_cjk | prev_space] = 1
    level[space | brk] = np.where(prev_brk, 3, -1)[space | brk]
    # The last character before each place that is no space.
    solid = np.maximum.accumulate(np.where(~space & (c != 13), at, -1))
    before = np.roll(solid, 1)
    before[0] = -1
    last = np.where(before >= 0, c[np.maximum(before, 0)], 10)
    after_stop = np.isin(prev, _STOPS) & ~np.isin(c, _STOPS)
    level[(after_stop | (prev_space & np.isin(last, _MARKS))) & ~space & ~brk] = 2
    level[prev_brk & ~((c == 10) & (prev == 13))] = 3
    # A line that is blank, or a heading, begins a paragraph; inside a fence it is a line like any other.
    older = np.roll(before, 1)
    blank = prev_brk & (np.roll(c, 1) == 10) & np.isin(np.where(older >= 0, c[np.maximum(older, 0)], 0), np.array([10], np.uint32))
    starts = np.flatnonzero(prev_brk | (at == 0))
    fence = np.zeros(n, bool)
    ticks = starts[(c[starts] == 96) & (c[np.minimum(starts + 1, n - 1)] == 96) & (c[np.minimum(starts + 2, n - 1)] == 96)]
    fence[ticks] = True
    inside = np.cumsum(fence) % 2 == 1
    level[(blank | (prev_brk & (c == 35))) & ~inside & ~brk] = 4
    level[_within(c, _JOINED)] = -1
    level[0] = 4
    return level


def cut_texts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """Of each text the (start, end) of its pieces, in order; a text within the limit is one piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    step = max(1, (limit - overlap) // 24)
    weights, places, levels, owner, first = [], [], [], [], []
    base, count = 0, 0
    for k, s in enumerate(texts):
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        ideograph = _within(c, _IDEOGRAPHS)
        w = np.concatenate([[0], np.cumsum(np.where(ideograph, 4, 1))])
        level = _levels(c, ideograph)
        # A run without boundaries gets one every `step` tokens, so that each piece can advance.
        natural = np.flatnonzero(level >= 0)
        hard = np.zeros(len(c), bool)
        gaps = np.diff(np.concatenate([w[natural], [w[-1]]]))
        for i in np.flatnonzero(gaps > 4 * step):
            a, b = natural[i], natural[i + 1] if i + 1 < len(natural) else len(c)
            at = np.searchsorted(w, np.arange(w[a] + 4 * step, w[b], 4 * step), "right") - 1
            hard[at[(at > a) & (at < b)]] = True
        level[hard & (level < 0) & ~_within(c, ((0xDC00, 0xDFFF),))] = 0
        p = np.append(np.flatnonzero(level >= 0), len(c))
        first.append(count)
        places.append(p)
        levels.append(np.append(level[p[:-1]], 5))
        owner.append(np.full(len(p), k))
        # Texts lie so far apart that no window reaches from one into the next.
        weights.append(w[p] + base)
        base += int(w[-1]) + 8 * limit
        count += len(p)
    w, place, level, own = map(np.concatenate, (weights, places, levels, owner))
    n = len(w)
    at = np.arange(n)
    firsts = np.array(first)
    ends = np.append(firsts[1:], n) - 1
    end_of = ends[own]

    earliest = np.maximum(np.searchsorted(w, w - 4 * overlap, "left"), firsts[own])
    next_natural = np.minimum.accumulate(np.where(level >= 2, at, n)[::-1])[::-1]
    start = np.where(next_natural[earliest] < at, next_natural[earliest], earliest)
    start[firsts] = firsts

    reach = np.minimum(np.searchsorted(w, w[start] + 4 * limit, "right") - 1, end_of)
    successor = np.full(n, -1)
    for lv in (4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(level >= lv, at, -1))[reach]
        good = (successor < 0) & (last > at) & (w[np.maximum(last, 0)] - w[start] >= 2 * limit)
        successor[good] = last[good]
    successor = np.where((successor < 0) | (reach == end_of), reach, successor)
    # A boundary so far away that the overlap doesn't fit in: begin at the cut itself.
    stuck = successor <= at
    if stuck.any():
        start[stuck] = at[stuck]
        far = np.minimum(np.searchsorted(w, w + 4 * limit, "right") - 1, end_of)
        successor[stuck] = np.maximum(far, np.minimum(at + 1, end_of))[stuck]
    successor[ends] = ends

    reached = np.zeros(n, bool)
    reached[firsts] = True
    jump = successor
    while True:
        reached[jump[reached]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump):
            break
        jump = squared
    cuts = np.flatnonzero(reached & (at != end_of))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i in cuts:
        out[own[i]].append((int(place[start[i]]), int(place[successor[i]])))
    return out


def _in_groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin, chars = 0, 0
    for i, s in enumerate(texts):
        if chars and chars + len(s) > AT_ONCE:
            yield begin, texts[begin:i]
            begin, chars = i, 0
        chars += len(s)
    if begin < len(texts):
        yield begin, texts[begin:]


def split_items(df: DataFrame, key: str, text: str, keep: list[str] = (), limit: int = LIMIT, overlap: int = OVERLAP, emit_text: bool = True) -> DataFrame:
    """key, keep..., piece (from 0), pieces, start, end (code points)[, the text of the piece].

    One row per piece; an item within the limit is its own only piece. Rows are taken as they are, repeated ones too.
    """
    keep = list(keep)
    own = df.select(F.col(key), *keep, F.col(text).alias("_text"))
    small: Column = within_tokens(F.col("_text"), limit)
    names = [key, *keep]
    whole = own.where(~is_blank(F.col("_text")) & small).select(
        *names,
        F.lit(0).alias("piece"),
        F.lit(1).alias("pieces"),
        F.lit(0).cast("long").alias("start"),
        F.length("_text").cast("long").alias("end"),
        *([F.col("_text").alias(text)] if emit_text else []),
    )
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", piece int, pieces int, start bigint, end bigint" + (f", `{text}` string" if emit_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for begin, group in _in_groups(texts):
                rows, nth, of, a, b, body = [], [], [], [], [], []
                for r, spans in enumerate(cut_texts(group, limit, overlap)):
                    for i, (x, y) in enumerate(spans):
                        rows.append(begin + r)
                        nth.append(i)
                        of.append(len(spans))
                        a.append(x)
                        b.append(y)
                        if emit_text:
                            body.append(group[r][x:y])
                take = pa.array(rows, pa.int64())
                columns = {c: batch.column(i).take(take) for i, c in enumerate(names)}
                columns |= {"piece": pa.array(nth, pa.int32()), "pieces": pa.array(of, pa.int32()), "start": pa.array(a, pa.int64()), "end": pa.array(b, pa.int64())}
                if emit_text:
                    columns[text] = pa.array(body, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return whole.unionByName(own.where(~small).select(*names, "_text").mapInArrow(cut, schema))

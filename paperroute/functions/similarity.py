"""Similarity scores without a built-in, vectorised over Arrow batches.

``partial_ratio`` slides the shorter string over the longer one and reports the best
normalised insert/delete similarity; ``seq_ratio`` is the Ratcliff-Obershelp ratio of the
standard library; ``nfkd`` is Unicode compatibility decomposition.
"""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType

_WORD = 64
_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROOM = 400_000  # words of 64 bits for the texts of pairs that are scored together
_DENSE = 1 << 16  # words of 64 bits for a table by character
_SPANS = 100_000  # stretches of text that advance together


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _edge_scores(needle: np.ndarray, text: np.ndarray) -> float:
    """Best score over the proper prefixes and suffixes of ``text`` shorter than the needle."""
    m = len(needle)
    best = 0.0
    for flip in (False, True):
        a = needle[::-1] if flip else needle
        b = (text[::-1] if flip else text)[: m - 1]
        width = len(b)
        if width == 0:
            continue
        # plain integer arithmetic: one pass yields the score of every prefix length
        masks: dict[int, int] = {}
        for i, ch in enumerate(a.tolist()):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << m) - 1
        state = full
        for length, ch in enumerate(b.tolist(), start=1):
            u = state & masks.get(ch, 0)
            state = ((state + u) | (state - u)) & full
            lcs = m - state.bit_count()
            best = max(best, 200.0 * lcs / (m + length))
    return best


def _best_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each (needle, longer text) pair the best score over the windows of the needle's length and the shorter ones at both ends.

    A window shares no longer subsequence with the needle than a block around it does, so after the
    windows of the most promising block only blocks that could still do better are cut into smaller ones, in the end
    into windows.  All pairs of the list are worked on together; needles take equally many words.
    """
    words = -(-max(len(x) for x, _ in pairs) // _WORD)
    m = np.array([len(x) for x, _ in pairs])
    n = np.array([len(y) for _, y in pairs])
    step = np.maximum(1, m // 2)
    base, hits = _all_hits(pairs, words, n + m + step)
    top = np.zeros(len(pairs), dtype=np.int64)

    def cut(owner: np.ndarray, first: np.ndarray, wide: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks of ``wide`` windows in blocks of ``into``; the last of them may have fewer windows."""
        parts = -(-wide // into)
        return np.repeat(owner, parts), np.repeat(first, parts) + _ranges(np.zeros(len(first), np.int64), parts) * np.repeat(into, parts), np.minimum(
            np.repeat(into, parts), np.repeat(wide, parts) - _ranges(np.zeros(len(first), np.int64), parts) * np.repeat(into, parts))

    def lcs(owner: np.ndarray, first: np.ndarray, wide: np.ndarray) -> np.ndarray:
        return _lcs_spans(hits, base[owner] + first, m[owner] + wide - 1, m[owner])

    every = np.arange(len(pairs))
    owner, first, wide = cut(every, np.zeros(len(pairs), np.int64), n - m + 1, step)
    bound = lcs(owner, first, wide)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    order = np.lexsort((np.arange(len(owner)), -bound, owner))
    tried = order[starts]  # of each pair the first block of the highest bound
    own, at, one = cut(owner[tried], first[tried], wide[tried], np.ones(len(tried), np.int64))
    np.maximum.at(top, own, lcs(own, at, one))
    left = np.ones(len(owner), bool)
    left[tried] = False
    while True:
        left &= bound > top[owner]
        owner, first, wide, bound = owner[left], first[left], wide[left], bound[left]
        single = wide == 1
        np.maximum.at(top, owner[single], bound[single])
        if single.all():
            break
        owner, first, wide = cut(owner[~single], first[~single], wide[~single], np.maximum(1, wide[~single] // 4))
        bound = np.empty(len(owner), np.int64)
        for lo in range(0, len(owner), _SPANS):
            some = slice(lo, lo + _SPANS)
            bound[some] = lcs(owner[some], first[some], wide[some])
        left = np.ones(len(owner), bool)

    best = 100.0 * top / m
    if words > 1:
        return np.array([max(score, _edge_scores(x, y)) for score, (x, y) in zip(best.tolist(), pairs)])
    for lo in range(0, len(pairs), _SPANS // _WORD):
        some = slice(lo, lo + _SPANS // _WORD)
        owner = np.repeat(every[some], m[some] - 1)
        size = _ranges(np.ones(len(m[some]), np.int64), m[some] - 1)
        able = 200.0 * size / (m[owner] + size) > best[owner]
        owner, size = owner[able], size[able]
        for first in (np.zeros(len(owner), np.int64), n[owner] - size):
            found = _lcs_spans(hits, base[owner] + first, size, m[owner])
            np.maximum.at(best, owner, 200.0 * found / (m[owner] + size))
    return best


def partial_ratio_of(a: str, b: str) -> float:
    """Best window similarity of two strings, 0 to 100."""
    return float(partial_ratios([a], [b])[0])


def partial_ratios(quotes: list[str], texts: list[str]) -> np.ndarray:
    """Best window similarity of each pair, 0 to 100; pairs are worked on together, as many as hold some text."""
    out = np.zeros(len(quotes))
    left: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def settle(batch: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for (i, x, y), best in zip(batch, _best_scores([(x, y) for _, x, y in batch]).tolist()):
            out[i] = max(best, _edge_scores(y, x)) if len(x) == len(y) else best

    used: dict[int, int] = {}
    for i, (a, b) in enumerate(zip(quotes, texts)):
        if not a or not b:
            out[i] = 100.0 if len(a) == len(b) else 0.0
            continue
        if len(a) > len(b):
            a, b = b, a
        if a in b:
            out[i] = 100.0
            continue
        words = -(-len(a) // _WORD)
        left.setdefault(words, []).append((i, _codes(a), _codes(b)))
        used[words] = used.get(words, 0) + len(b)
        if used[words] * words >= _ROOM:
            settle(left.pop(words))
            used[words] = 0
    for batch in left.values():
        settle(batch)
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: no fewer characters than any blocks matched in order hold."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    state = full = (1 << len(a)) - 1
    for ch in b:
        u = state & masks.get(ch, 0)
        if u:
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def seq_ratio_of(a: str, b: str, floor: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio, 0 when two upper bounds, lengths and the longest common subsequence, show it cannot reach ``floor``."""
    total = len(a) + len(b)
    if floor > 0 and total:
        if 2.0 * min(len(a), len(b)) / total < floor:
            return 0.0
        if 2.0 * _common(a, b) / total < floor:
            return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def fn_partial_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    both = [i for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None]
    out = np.full(len(left), np.nan)
    out[both] = partial_ratios([left.iloc[i] for i in both], [right.iloc[i] for i in both])
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


@F.pandas_udf(DoubleType())
def fn_seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else seq_ratio_of(a, b) for a, b in zip(left, right)],
        dtype="float64",
    )


@lru_cache(maxsize=16)
def seq_ratio_from(floor: float):
    """``fn_seq_ratio`` for callers that only need ratios of ``floor`` or more; others may come out as 0."""

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [None if a is None or b is None else seq_ratio_of(a, b, floor) for a, b in zip(left, right)],
            dtype="float64",
        )

    return ratio


@F.pandas_udf(StringType())
def fn_nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def _hits(needle: np.ndarray, text: np.ndarray, words: int) -> np.ndarray:
    """For each text position the needle positions holding the same character, as bit words."""
    size = int(max(needle.max(), text.max())) + 1
    if size * words <= _DENSE:
        table = np.zeros((size, words), dtype=np.uint64)
        at = np.arange(len(needle))
        np.bitwise_or.at(table, (needle, at // _WORD), _ONE << (at % _WORD).astype(np.uint64))
        return table[text]
    chars, slot = np.unique(needle, return_inverse=True)
    table = np.zeros((len(chars) + 1, words), dtype=np.uint64)
    at = np.arange(len(needle))
    np.bitwise_or.at(table, (slot, at // _WORD), _ONE << (at % _WORD).astype(np.uint64))
    where = np.searchsorted(chars, text)
    where[where == len(chars)] = 0
    return table[np.where(chars[where] == text, where, len(chars))]


def _all_hits(pairs: list[tuple[np.ndarray, np.ndarray]], words: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the text of each pair begins, with so much room each, and the hits of all texts end to end."""
    base = np.concatenate([[0], np.cumsum(room)])
    hits = np.zeros((int(base[-1]), words), dtype=np.uint64)
    for i, (x, y) in enumerate(pairs):
        hits[base[i] : base[i] + len(y)] = _hits(x, y, words)
    return base, hits


def _lcs_spans(hits: np.ndarray, starts: np.ndarray, spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each stretch of text with its own needle.

    ``hits`` holds the texts of many pairs end to end; a stretch is a start and a length, and
    ``sizes`` is the length of its needle.  All stretches advance one character per step.
    """
    words = hits.shape[1]
    order = np.argsort(-spans, kind="stable")
    at, left = starts[order], spans[order]
    state = np.full((words, len(at)), _FULL, dtype=np.uint64)
    running = len(at)
    for j in range(int(left[0]) if len(left) else 0):
        while running and left[running - 1] <= j:
            running -= 1
        rows = hits[at[:running] + j]
        carry = None
        for w in range(words):
            v = state[w, :running]
            u = v & rows[:, w]
            total = v + u
            over = total < v if w + 1 < words else None
            if carry is not None:
                more = total + carry
                if over is not None:
                    over |= more < total
                total = more
            if over is not None:
                carry = over.astype(np.uint64)
            state[w, :running] = total | (v - u)
    size = sizes[order]
    found = np.zeros(len(at), dtype=np.int64)
    for w in range(words):
        valid = np.clip(size - w * _WORD, 0, _WORD)
        mask = np.where(valid >= _WORD, _FULL, (_ONE << np.minimum(valid, _WORD - 1).astype(np.uint64)) - _ONE)
        found += np.bitwise_count(~state[w] & mask)
    out = np.empty(len(at), dtype=np.int64)
    out[order] = found
    return out


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` for each i, end to end."""
    total = int(counts.sum())
    ahead = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + np.arange(total) - ahead


def _windows_reach(pairs: list[tuple[np.ndarray, np.ndarray]], floor: float) -> np.ndarray:
    """For each (needle, longer text) pair: does some full-width window reach ``floor``?

    Windows inside a block share no longer subsequence with the needle than the block does, so
    whole blocks are dropped first.  All pairs of the list are worked on together.
    """
    reached = np.zeros(len(pairs), dtype=bool)
    words = -(-max(len(x) for x, _ in pairs) // _WORD)
    m = np.array([len(x) for x, _ in pairs])
    n = np.array([len(y) for _, y in pairs])
    step = np.maximum(1, m // 2)
    base, hits = _all_hits(pairs, words, n + m + step)
    blocks = -(-(n - m + 1) // step)
    owner = np.repeat(np.arange(len(pairs)), blocks)
    first = _ranges(np.zeros(len(pairs), dtype=np.int64), blocks) * step[owner]
    best = _lcs_spans(hits, base[owner] + first, (m + step - 1)[owner], m[owner])
    good = best >= floor * m[owner] / 100.0 - 1e-9
    owner, first = owner[good], first[good]
    count = np.minimum(step[owner], n[owner] - m[owner] + 1 - first)
    start = _ranges(first, count)
    owner = np.repeat(owner, count)
    for lo in range(0, len(owner), 500_000):
        own, at = owner[lo : lo + 500_000], start[lo : lo + 500_000]
        open_ = ~reached[own]
        own, at = own[open_], at[open_]
        lcs = _lcs_spans(hits, base[own] + at, m[own], m[own])
        reached[own[100.0 * lcs / m[own] >= floor]] = True
    return reached


def reach_floor(quotes: list[str], texts: list[str], floor: float) -> np.ndarray:
    """For each pair: is the partial ratio at least ``floor``?"""
    out = np.zeros(len(quotes), dtype=bool)
    left: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for i, (a, b) in enumerate(zip(quotes, texts)):
        if not a or not b:
            out[i] = floor <= (100.0 if len(a) == len(b) else 0.0)
            continue
        if len(a) > len(b):
            a, b = b, a
        if a in b:
            out[i] = floor <= 100.0
        else:
            left.setdefault(-(-len(a) // _WORD), []).append((i, _codes(a), _codes(b)))
    for words, group in left.items():
        batch: list[tuple[int, np.ndarray, np.ndarray]] = []
        room = 4_000_000 // words
        used = 0
        for k, item in enumerate(group):
            batch.append(item)
            used += len(item[2])
            if used >= room or k + 1 == len(group):
                flags = _windows_reach([(x, y) for _, x, y in batch], floor)
                for (i, x, y), flag in zip(batch, flags):
                    out[i] = flag or _edge_scores(x, y) >= floor or (
                        len(x) == len(y) and _edge_scores(y, x) >= floor
                    )
                batch, used = [], 0
    return out


@F.pandas_udf(IntegerType())
def count_similar(quotes: pd.Series, text: pd.Series, floor: pd.Series) -> pd.Series:
    """How many of the quotes reach ``floor`` somewhere in the text; null quotes never do."""
    counts = np.zeros(len(text), dtype=np.int32)
    rows, needles, bodies = [], [], []
    for i, (qs, t) in enumerate(zip(quotes, text)):
        if qs is not None and t is not None:
            for q in qs:
                if q is not None:
                    rows.append(i)
                    needles.append(q)
                    bodies.append(t)
    if rows:
        np.add.at(counts, rows, reach_floor(needles, bodies, float(floor.iloc[0])).astype(np.int32))
    return pd.Series(counts)


@F.pandas_udf(BooleanType())
def each_has_similar(wanted: pd.Series, found: pd.Series, floor: pd.Series) -> pd.Series:
    """True when every wanted item reaches ``floor`` against some found item."""

    def settled(item, options, limit) -> bool:
        return item is not None and any(o and seq_ratio_of(item, o, limit) >= limit for o in options)

    return pd.Series(
        [
            ws is not None and fs is not None and all(settled(w, fs, f) for w in ws)
            for ws, fs, f in zip(wanted, found, floor)
        ]
    )


def decompose(col):
    """Compatibility decomposition; plain ASCII values are not sent to Python."""
    odd = col.rlike(r"[^\x00-\x7f]")
    return F.coalesce(fn_nfkd(F.when(odd, col)), col)

"""Token ids of whole texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import tokenizer
from .words import Texts, eights, hashes_of_eights

REMEMBERED_BYTES = 96 << 20
AT_ONCE = 2_000
LONGEST_TAIL = 3
# between an ASCII letter and ASCII punctuation both pre-tokenizers always cut, but for an apostrophe; other
# letters may be decomposed first and then end in a mark, where the cut is another
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
WHOLE = -1  # instead of a number of ids: texts with this unit are encoded as a whole


class Grown:
    """An array that takes more values at its end."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            wider = np.zeros(2 * (self.size + len(more)), self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class Memory:
    """Ids of units (a word behind a space, or a stretch without one), found by hash and compared byte by byte."""

    def __init__(self):
        self.table = np.full(1 << 12, -1, np.int32)
        self.hash, self.length, self.spaced = Grown(np.uint64), Grown(np.int64), Grown(bool)
        self.first_eight, self.eights = Grown(np.int64), Grown(np.uint64)
        self.first_id, self.n_ids, self.ids = Grown(np.int64), Grown(np.int64), Grown(np.uint32)

    def bytes_held(self) -> int:
        grown = (self.hash, self.length, self.spaced, self.first_eight, self.eights, self.first_id, self.n_ids, self.ids)
        return self.table.nbytes + sum(g.room.nbytes for g in grown)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The unit with each hash, or -1."""
        mask = len(self.table) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        unit = self.table[at]
        open_ = np.flatnonzero(unit >= 0)
        open_ = open_[self.hash.room[unit[open_]] != keys[open_]]
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            now = self.table[at[open_]]
            unit[open_] = now
            open_ = open_[(now >= 0) & (self.hash.room[now] != keys[open_])]
        return unit

    def _place(self, keys: np.ndarray, units: np.ndarray) -> None:
        mask = len(self.table) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(units):
            free = self.table[at] < 0
            self.table[at[free]] = units[free]  # of several the last one stays
            lost = self.table[at] != units
            at, units = (at[lost] + 1) & mask, units[lost]

    def add(self, keys, lengths, spaced, first_eights, all_eights, n_ids, ids) -> None:
        """Takes units with different hashes that it does not hold yet."""
        units = np.arange(self.hash.size, self.hash.size + len(keys), dtype=np.int32)
        self.first_eight.add(first_eights + self.eights.size)
        self.eights.add(all_eights)
        counts = np.maximum(n_ids, 0)
        self.first_id.add(self.ids.size + np.cumsum(counts) - counts)
        self.ids.add(ids)
        for grown, more in ((self.hash, keys), (self.length, lengths), (self.spaced, spaced), (self.n_ids, n_ids)):
            grown.add(more)
        if 2 * self.hash.size > len(self.table):
            self.table = np.full(1 << (3 * self.hash.size).bit_length(), -1, np.int32)
            keys, units = self.hash.values, np.arange(self.hash.size, dtype=np.int32)
        self._place(keys, units)


class WordEncoder:
    """Ids of texts, the same as from encoding every whole text.

    The pre-tokenizers of the supported vocabularies never join what stands on both sides of a
    single space between two characters that are not white space, so such a text is the
    concatenation of its words, each with the space before it; punctuation behind a letter is a unit
    of its own.  Units are found in the bytes of the whole batch, looked up by hash and compared byte by
    byte; only new ones reach the library.  They are remembered up to ``REMEMBERED_BYTES`` and those
    of the batch at hand, then the memory starts afresh.  A text with any other white space around a
    space is encoded as a whole.
    """

    def __init__(self, model: str):
        self.tokenizer = tokenizer(model)
        self.memory = Memory()

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words in one string, each after a space, and tells their ids apart by place."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(words), AT_ONCE):
            some = words[k : k + AT_ONCE]
            found = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])  # of the spaces
            counts.append(np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(some)))
            ids.append(np.array(found.ids, np.uint32))
        return np.concatenate(counts), np.concatenate(ids)

    def _learn(self, data: np.ndarray, begins, ends, spaced, keys) -> None:
        """Encodes units of different hashes: first the words behind a space, then the others."""
        order = np.argsort(~spaced, kind="stable")
        begins, ends, spaced, keys = begins[order], ends[order], spaced[order], keys[order]
        texts = [data[a:b].tobytes().decode() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        odd = np.array([t[-1].isspace() or (s and t[0].isspace()) for t, s in zip(texts, spaced.tolist(), strict=True)], bool)
        words = [t for t, s, o in zip(texts, spaced.tolist(), odd.tolist(), strict=True) if s and not o]
        others = [t for t, s, o in zip(texts, spaced.tolist(), odd.tolist(), strict=True) if not s and not o]
        counts, ids = self._words(words)
        alone = self._alone(others)
        n_ids = np.full(len(texts), WHOLE, np.int64)
        n_ids[~odd] = np.concatenate([counts, np.array([len(x) for x in alone], np.int64)])
        value, first, _ = eights(data, begins, ends)
        self.memory.add(keys, ends - begins, spaced, first, value, n_ids, np.concatenate([ids, *alone]))

    def _units(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of all units, whether a space stands before each, its row, and rows with two spaces together."""
        data, spaces = texts.bytes, np.flatnonzero(texts.bytes == 0x20)
        begins = np.sort(np.concatenate([texts.offsets[:-1], spaces + 1]), kind="stable")
        ends = np.sort(np.concatenate([texts.offsets[1:], spaces]), kind="stable")
        per_row = np.diff(np.searchsorted(spaces, texts.offsets)) + 1
        row = np.repeat(np.arange(texts.rows), per_row)
        spaced = np.ones(len(begins), bool)
        spaced[np.cumsum(per_row) - per_row] = False
        held = ends > begins
        odd_rows = row[~held & spaced]
        begins, ends, spaced, row = begins[held], ends[held], spaced[held], row[held]
        base = ends.copy()
        open_ = np.arange(len(base))
        for _ in range(LONGEST_TAIL):
            open_ = open_[(base[open_] > begins[open_] + 1) & PUNCTUATION[data[base[open_] - 1]]]
            base[open_] -= 1
        parted = (base < ends) & LETTER[data[base - 1]]
        base[~parted] = ends[~parted]
        of = np.repeat(np.arange(len(base)), 1 + parted)
        second = np.concatenate([[False], of[1:] == of[:-1]]) if len(of) else parted
        return np.where(second, base[of], begins[of]), np.where(second, ends[of], base[of]), spaced[of] & ~second, row[of], odd_rows

    def ids_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        texts = Texts(column)
        begins, ends, spaced, row, odd_rows = self._units(texts)
        sizes = ends - begins
        value, first, nth = eights(texts.bytes, begins, ends)
        keys = hashes_of_eights(value, first, nth, 2 * sizes + spaced)
        if self.memory.bytes_held() > REMEMBERED_BYTES:
            self.memory = Memory()
        memory = self.memory
        unit = memory.find(keys)
        new = np.flatnonzero(unit < 0)
        if len(new):
            pick = new[np.unique(keys[new], return_index=True)[1]]
            self._learn(texts.bytes, begins[pick], ends[pick], spaced[pick], keys[pick])
            unit[new] = memory.find(keys[new])
        same = (memory.length.room[unit] == sizes) & (memory.spaced.room[unit] == spaced)
        blocks = (sizes + 7) >> 3
        stored = np.repeat(np.where(same, memory.first_eight.room[unit], 0), blocks) + nth * np.repeat(same, blocks)
        same[np.repeat(np.arange(len(unit)), blocks)[memory.eights.room[stored] != value]] = False
        counts = np.where(same, memory.n_ids.room[unit], WHOLE)
        odd_rows = np.union1d(odd_rows, row[counts == WHOLE])
        counts[np.isin(row, odd_rows)] = 0
        total = int(counts.sum())
        ids = memory.ids.room[np.repeat(memory.first_id.room[unit] - (np.cumsum(counts) - counts), counts) + np.arange(total)]
        n_ids = np.bincount(row, counts, texts.rows).astype(np.int64)
        if len(odd_rows):
            each = np.split(ids, np.cumsum(n_ids)[:-1])
            for i, found in zip(odd_rows.tolist(), self._alone(column.take(pa.array(odd_rows, pa.int64())).to_pylist()), strict=True):
                each[i], n_ids[i] = found, len(found)
            ids = np.concatenate(each)
        return ids, n_ids

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return []
        ids, n_ids = self.ids_of(column)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n_ids)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def word_encoder(model: str) -> WordEncoder:
    return WordEncoder(model)

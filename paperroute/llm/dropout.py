"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, sentence_pieces, text_of
from .words import mixed

SLICE = 1 << 20
MARK = 0x2581  # stands for a space inside pieces
NO_PIECE = -1
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LONG = 128  # longer stretches without a certain boundary are merged one by one
SALT = np.uint64(0xD6E8FEB86659FD93)


class Merges:
    """The vocabulary as arrays: ids of characters, merges of two pieces with their ranks, bytes of pieces."""

    def __init__(self, model: str):
        sp = sentence_pieces(model)
        size = sp.vocab_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        names = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.bytes_at = next(i for i in range(size) if sp.is_byte(i))
        self.char = np.full(0x110000, NO_PIECE, np.int32)
        for piece, i in names.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        scores = sorted({sp.get_score(i) for i in names.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        merges = [(names[p[:k]], names[p[k:]], i, rank[sp.get_score(i)]) for p, i in names.items() for k in range(1, len(p)) if p[:k] in names and p[k:] in names]
        left, right, made, order = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.of_pair = {(a, b): (r, m) for a, b, m, r in merges}
        # open addressing, probed for whole arrays at once
        self.slots = 1 << (4 * len(merges)).bit_length()
        self.keys = np.full(self.slots, -1, np.int64)
        self.made, self.rank = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint64)
        for key, slot, m, r in zip(((left << 32) | right).tolist(), self._slot(left, right).tolist(), made.tolist(), order.tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.slots
            self.keys[slot], self.made[slot], self.rank[slot] = key, m, r
        text = [bytes([i - self.bytes_at]) if sp.is_byte(i) else b"" if special[i] else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.lengths = np.array([len(x) for x in text], np.int64)
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed_up = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed_up ^ (mixed_up >> np.uint64(29))) >> np.uint64(11)).astype(np.int64) & (self.slots - 1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of the merge of each pair, or -1."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(left, right)
        found = self.keys[at]
        out = np.where(found == key, at, -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            now = self.keys[at[open_]]
            hit = now == key[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (now >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids, the mark of the first one included."""
        n = self.lengths[ids]
        total = int(n.sum())
        return self.flat[np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n) + np.arange(total)]


@lru_cache(maxsize=2)
def merges_of(model: str) -> Merges:
    return Merges(model)


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether the merge of two neighbouring stretches of a text is left out: a hash of the text's key and the places."""
    places = start.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + middle.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + end.astype(np.uint64) * SALT
    return mixed(key ^ places) < limit


def _one_by_one(m: Merges, symbols: list[int], at: int, key: np.uint64, limit: np.uint64) -> list[tuple[int, int]]:
    """The agenda as a heap, for a long stretch: places and pieces."""
    n = len(symbols)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ends = list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i] if i >= 0 else n
        if i < 0 or j >= n:
            return
        merge = m.of_pair.get((symbols[i], symbols[j]))
        if merge is None:
            return
        if limit and skipped(*(np.array([x], np.uint64) for x in (key, at + i, at + j, at + ends[j])), limit)[0]:
            return
        heapq.heappush(agenda, (merge[0], i, j, ends[j], merge[1]))

    for i in range(n):
        offer(i)
    gone = [False] * n
    while agenda:
        _, i, j, end, made = heapq.heappop(agenda)
        if gone[i] or following[i] != j or j >= n or ends[j] != end or ends[i] != j:
            continue
        symbols[i], gone[j] = made, True
        ends[i], following[i] = end, following[j]
        if following[j] < n:
            before[following[j]] = i
        offer(before[i])
        offer(i)
    return [(at + i, symbols[i]) for i in range(n) if not gone[i]]


def encode_batch(model: str, texts: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each text has.

    All texts go side by side.  Nothing is ever merged across the begin of a word (no piece holds a
    mark after another character) or next to a character without a piece, so the stretches between
    are independent agendas.  In every round each stretch makes its best merge, by rank and then
    from the left, until it has none; a candidate merge is skipped for good when its hash says so.
    """
    m = merges_of(model)
    limit = np.uint64(0) if dropout <= 0 else np.uint64(min(int(dropout * 2**64), 2**64 - 1))
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    code = np.frombuffer("".join("▁" + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    first = np.zeros(len(code), bool)
    first[firsts[sizes > 0]] = True
    code = np.where(code == 0x20, MARK, np.where((code == MARK) & ~first, -MARK, code))  # a mark of the text itself goes as bytes
    symbol = np.where(code >= 0, m.char[np.abs(code)], NO_PIECE)
    final = symbol.copy()
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(code)) - firsts[row]

    unknown = symbol == NO_PIECE
    new = first.copy()
    if len(code):
        new[1:] |= ((code[1:] == MARK) & (code[:-1] != MARK)) | unknown[1:] | unknown[:-1]
    begins = np.flatnonzero(new)
    lengths = np.diff(np.append(begins, len(code)))
    alive = np.ones(len(code), bool)  # whether a piece begins at the character
    for b, n in zip(begins[lengths > LONG].tolist(), lengths[lengths > LONG].tolist(), strict=True):
        alive[b : b + n] = False
        for at, piece in _one_by_one(m, symbol[b : b + n].tolist(), int(place[b]), keys[row[b]], limit):
            alive[b + at - int(place[b])] = True
            final[b + at - int(place[b])] = piece

    # the stretches with something to merge, as compact arrays
    use = np.repeat((lengths > 1) & (lengths <= LONG), lengths)
    at = np.flatnonzero(use)
    s, stretch = symbol[at].astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)[at]
    end = at + 1

    def offers(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merges of the pieces at i with the next ones; NONE if there is none."""
        slot = m.look_up(s[i], s[i + 1])
        ok = slot >= 0
        rank = np.where(ok, m.rank[slot], NONE)
        if limit and ok.any():
            k = np.flatnonzero(ok)
            here = at[i[k]]
            drop = skipped(keys[row[here]], place[here], place[at[i[k] + 1]], place[here] + (end[i[k] + 1] - here), limit)
            rank[k[drop]] = NONE
        return rank, m.made[slot]

    if len(at):
        rank, made = np.full(len(at), NONE), np.zeros(len(at), np.int32)
        inner = np.flatnonzero(stretch[:-1] == stretch[1:])
        rank[inner], made[inner] = offers(inner)
    while len(at):
        starts = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        order = np.where(rank == NONE, NONE, (rank << np.uint64(32)) | np.arange(len(at), dtype=np.uint64))
        best = np.minimum.reduceat(order, starts)
        if (best == NONE).any():  # these are done
            counts = np.diff(np.append(starts, len(at)))
            done = np.repeat(best == NONE, counts)
            final[at[done]] = s[done]
            keep = ~done
            moved = np.cumsum(keep) - 1
            at, s, stretch, end, rank, made = (x[keep] for x in (at, s, stretch, end, rank, made))
            best = moved[(best[best != NONE] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            if not len(at):
                break
        else:
            best = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s[best], end[best] = made[best], end[best + 1]
        alive[at[best + 1]] = False
        keep = np.ones(len(at), bool)
        keep[best + 1] = False
        best = (np.cumsum(keep) - 1)[best]
        at, s, stretch, end, rank, made = (x[keep] for x in (at, s, stretch, end, rank, made))
        rank[best] = NONE
        right = best[best + 1 < len(at)]
        right = right[stretch[right] == stretch[right + 1]]
        rank[right], made[right] = offers(right)
        left = best[best > 0]
        left = left[stretch[left - 1] == stretch[left]] - 1
        rank[left], made[left] = offers(left)

    # characters without a piece become one id for each of their bytes
    there = np.flatnonzero(alive)
    piece, char = final[there], np.abs(code[there])
    n = np.where(piece == NO_PIECE, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
    ids = np.repeat(piece, n).astype(np.int64)
    lost = np.flatnonzero(ids == NO_PIECE)
    if len(lost):
        owner = np.repeat(np.arange(len(there)), n)[lost]
        nth = lost - (np.cumsum(n) - n)[owner]
        c, width = char[owner], n[owner]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
        value = np.where(nth == 0, lead | (c >> (6 * (width - 1))), 0x80 | ((c >> (6 * (width - 1 - nth))) & 0x3F))
        ids[lost] = m.bytes_at + value
    return ids, np.bincount(row[there], weights=n, minlength=len(texts)).astype(np.int64)


def encode_with_dropout(
    docs: DataFrame, dropout: float = 0.1, seed: int = 1, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text under merge-dropout: ``doc_id, n_bytes, text_crc32, ids`` (little-endian unsigned 32-bit).

    Each candidate merge of the BPE agenda is skipped with probability ``dropout``, decided by a hash
    of the seed, the document's id and the places the merge would join.  The result depends on
    nothing else: not on partitions, batches or order.  Another seed gives other segmentations; with
    ``dropout`` 0 the ids are those of the sentencepiece library.  One thing differs from it: the
    character U+2581 inside a text is encoded by its bytes, so that decoding gives it back.

    Null texts are empty, empty texts have no ids, a null id counts as 0 for the hash; rows that
    repeat are encoded alike.  Columns other than the id and the text are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("text_crc32"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            numbers = batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
            keys = mixed(numbers * SALT + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
            ids, counts = encode_batch(model, texts, keys, dropout)
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32))
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), size, batch.column("text_crc32"), packed], names=["doc_id", "n_bytes", "text_crc32", "ids"])

    return rows.mapInArrow(encode, "doc_id bigint, n_bytes bigint, text_crc32 bigint, ids binary")


def decode_ids(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Replaces ``ids`` by ``text``, their bytes without the mark before the first word."""
    kinds = [f"`{c}` {t}" for c, t in encoded.drop("ids").dtypes]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges_of(model)
        for batch in in_slices(batches, "ids", 2 * SLICE):
            texts = [m.decode(np.frombuffer(x, "<u4").astype(np.int64)).tobytes()[1:] if x else b"" for x in batch.column("ids").to_pylist()]
            others = [name for name in batch.schema.names if name != "ids"]
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(texts, pa.binary())], names=[*others, "text"])

    return encoded.mapInArrow(decode, ", ".join([*kinds, "text binary"]))


def encoded_documents(docs: DataFrame, dropout: float = 0.1, seed: int = 1, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Every document encoded and decoded again: ``doc_id, n_bytes, n_tokens, ids_crc32, lossless``."""
    encoded = encode_with_dropout(docs, dropout, seed, model)
    encoded = encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))
    back = decode_ids(encoded, model)
    same = (F.crc32("text") == F.col("text_crc32")) & (F.octet_length("text") == F.col("n_bytes"))
    return back.select("doc_id", "n_bytes", "n_tokens", "ids_crc32", same.alias("lossless"))

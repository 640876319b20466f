"""Merge-dropout, token counts, packing and packed files against the tokenizer libraries."""

import unicodedata
import zlib

import numpy as np
import pytest
from cases import EDGES, documents, edge_docs, no_docs

from paperroute.llm import dropout, encoding
from paperroute.llm.binary import document_ids, pack, read_ids, unpack, write_ids
from paperroute.llm.common import sentence_pieces, tokenizer
from paperroute.llm.counting import spliced_count, token_counts
from paperroute.llm.dropout import encode_batch, encode_with_dropout, encoded_documents, merges_of
from paperroute.llm.encoding import WordEncoder
from paperroute.llm.packing import pack_lengths, packed_documents, slots_of, token_pieces
from paperroute.llm.words import mixed
from paperroute.session import work_dir

PIECES = "piece_bpe_32k.model"
ODD = ["", " ", "  a  b", "a\n b <s> c</s>d", "\n\nfoo bar ", " " * 500, "x" * 700, "漢字 🙂🙂 a" * 30, "é́ \x00 q", "a" * 5 + " " * 40 + "b", "it's 's we'll", "a,b., !! c<|endoftext|>.", "end<|startoftext|> é."]


def texts_of(spark, n=60):
    return [r.text for r in documents(spark).limit(n).collect()] + ODD


@pytest.fixture(scope="module")
def some(spark):
    return texts_of(spark)


def test_dropout_zero_is_the_library(some):
    ids, counts = encode_batch(PIECES, some, np.zeros(len(some), np.uint64), 0.0)
    ends = np.cumsum(counts)
    sp = sentence_pieces(PIECES)
    for text, a, b in zip(some, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == sp.encode(text)


@pytest.mark.parametrize("rate", [0.1, 0.6, 1.0])
def test_dropout_is_lossless_and_keyed(some, rate, monkeypatch):
    keys = mixed(np.arange(len(some), dtype=np.uint64))
    ids, counts = encode_batch(PIECES, some, keys, rate)
    ends = np.cumsum(counts)
    m = merges_of(PIECES)
    for text, a, b in zip(some, ends - counts, ends, strict=True):
        assert m.decode(ids[a:b]).tobytes()[1:] == text.encode()
    alone = [encode_batch(PIECES, [t], keys[i : i + 1], rate)[0] for i, t in enumerate(some)]
    assert np.concatenate(alone).tolist() == ids.tolist()
    monkeypatch.setattr(dropout, "LONG", 2)  # the heap makes the same merges as the rounds
    assert encode_batch(PIECES, some, keys, rate)[0].tolist() == ids.tolist()
    if rate < 1:
        assert encode_batch(PIECES, some, keys + np.uint64(1), rate)[0].tolist() != ids.tolist()


def test_dropout_mark_in_text():
    ids, _ = encode_batch(PIECES, ["a▁b ▁"], np.zeros(1, np.uint64), 0.1)
    assert merges_of(PIECES).decode(ids).tobytes()[1:].decode() == "a▁b ▁"


def test_dropout_query_edges(spark):
    got = encoded_documents(edge_docs(spark)).collect()
    assert len(got) == len(EDGES) and all(r.lossless for r in got)
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t, *_ in EDGES)
    assert encoded_documents(no_docs(spark)).count() == 0
    one = encode_with_dropout(edge_docs(spark).repartition(5)).collect()
    two = encode_with_dropout(edge_docs(spark).coalesce(1)).collect()
    key = lambda r: (str(r.doc_id), r.n_bytes, bytes(r.ids))
    assert sorted(map(key, one)) == sorted(map(key, two))


@pytest.mark.parametrize("chunk, overlap", [(50, 4), (200, 20), (1000, 100)])
def test_spliced_counts(some, chunk, overlap):
    sp = sentence_pieces(PIECES)
    for text in some:
        assert spliced_count(PIECES, text, chunk, overlap) == len(sp.encode(text))


def test_token_counts_edges(spark):
    sp = sentence_pieces(PIECES)
    want = sorted((str(i), len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, *_ in EDGES)
    for chunk in (1 << 15, 300):
        got = token_counts(edge_docs(spark), limit=100, chunk=chunk, overlap=30).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts(no_docs(spark)).count() == 0


@pytest.mark.parametrize("model", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_as_in_their_texts(some, model):
    extra = some + [t or "" for _, t, *_ in EDGES]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer(model).encode_batch(extra, add_special_tokens=False)]
    assert WordEncoder(model).encode(extra) == want


@pytest.mark.parametrize("model", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_in_small_batches_and_with_little_memory(some, model, monkeypatch):
    """Batches share their words; a memory that is full starts afresh; equal hashes of different words do no harm."""
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer(model).encode_batch(some, add_special_tokens=False)]
    encoder = WordEncoder(model)
    assert [encoder.encode([t])[0] for t in some] == want == encoder.encode(some)
    held = encoder.memory.hash.size
    assert encoder.encode(some[::-1]) == want[::-1] and encoder.memory.hash.size == held
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", 0)
    assert [encoder.encode([t])[0] for t in some] == want
    assert encoder.memory.hash.size < held
    monkeypatch.setattr(encoding, "hashes_of_eights", lambda value, first, nth, sizes: np.asarray(sizes % 3).astype(np.uint64))
    assert WordEncoder(model).encode(some) == want


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    payload = pack(ids, bits)
    assert len(payload) == -(-1001 * bits // 8)
    for a, b in ((0, 1001), (0, 0), (7, 8), (500, 777)):
        assert unpack(payload, bits, a, b).tolist() == ids[a:b].tolist()
    if bits < 32:
        with pytest.raises(ValueError):
            pack(np.array([2**bits], np.uint64), bits)


def plain_ids(rows, model, end):
    t = tokenizer(model)
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for i, x in rows]


@pytest.mark.parametrize("source", ["edges", "documents"])
def test_packed_files(spark, source):
    docs = edge_docs(spark) if source == "edges" else documents(spark)
    path = work_dir(spark, "packed-test")
    write_ids(docs, path)
    got = document_ids(spark, path, with_ids=True).collect()
    want = plain_ids([(r.doc_id, r.text) for r in docs.collect()], "byte_bpe_50k.json", 2)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in want)
    at = 0
    last = -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert read_ids(spark, path).selectExpr("max(bits)").first()[0] == 16


def test_packed_files_of_nothing(spark):
    path = work_dir(spark, "packed-test")
    write_ids(no_docs(spark), path)
    assert document_ids(spark, path).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("source, capacity", [("edges", 64), ("documents", 4096), ("documents", 300)])
def test_packing(spark, source, capacity):
    docs = edge_docs(spark) if source == "edges" else documents(spark)
    got = packed_documents(docs, capacity).collect()
    want = plain_ids([(r.doc_id, r.text) for r in docs.collect()], "word_bpe_49k.json", 1)
    pieces = sorted((str(i), k // capacity, k, len(x[k : k + capacity]), zlib.crc32(x[k : k + capacity].tobytes())) for i, x in want for k in range(0, len(x), capacity))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    used = check_packing(got, capacity)
    least = -(-sum(r.length for r in got) // capacity)
    assert used <= least + max(1, least // 50)


def test_packing_of_nothing(spark):
    assert packed_documents(no_docs(spark)).count() == 0
    assert token_pieces(no_docs(spark), with_ids=True).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_lengths(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 400))
    counts = {int(n): int(rng.integers(1, 10 ** int(rng.integers(1, 6)))) for n in rng.integers(1, capacity + 1, 40)}
    patterns = pack_lengths(counts, capacity)
    used: dict[int, int] = {}
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern) <= capacity and times > 0
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    assert len(patterns) <= 4 * capacity
    slots = slots_of(patterns)
    for n, part in slots.groupby("length"):
        assert part["rank_from"].tolist() == [0, *part["rank_to"].tolist()[:-1]] and part["rank_to"].max() == counts[n]


def test_exact_complements():
    # a single, a pair and a triple fill what the long ones leave; nothing is wasted
    assert sum(t for _, t in pack_lengths({90: 5, 10: 5}, 100)) == 5
    assert sum(t for _, t in pack_lengths({80: 3, 13: 3, 7: 3}, 100)) == 3
    assert sum(t for _, t in pack_lengths({70: 2, 15: 2, 9: 2, 6: 2}, 100)) == 2
    assert pack_lengths({}, 100) == []
    assert sum(t for _, t in pack_lengths({1: 10**12}, 4096)) == -(-(10**12) // 4096)


@pytest.mark.parametrize("model", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_letter_before_punctuation(model):
    """Words that end in a letter and punctuation, for every letter that decomposes and many others."""
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and (unicodedata.normalize("NFKD", chr(c)) != chr(c) or c % 97 == 0) and not 0xAC00 <= c < 0xD7A0]
    marks = "!.,;:)]}\"#$%&*+-/=?@[\\^_`{~"
    texts = [f"x AL{c}{m} next VEL{c}{m}" for c in letters for m in (marks if unicodedata.decomposition(c)[:1] not in ("", "<") else marks[:3])]
    plain = tokenizer(model)
    got = WordEncoder(model).encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []

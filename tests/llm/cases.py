"""Inputs and plain versions shared by the tests of the training-data operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "one passage of well over fifty bytes that stands in several of these documents"

EDGES = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8, "en", "a", 400),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8, "en", "a", 400),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8, "en", "a", 400),
    (3, None, None, None, None),
    (4, "", "", "", 0),
    (5, " \n\t ", "de", "b", 4),
    (6, "two words", "de", "b", 9),
    (7, "Two WORDS", "de", None, 9),
    (None, "a row without an id but with a text of some words in it", "fr", "b", None),
    (None, None, None, None, None),
    (8, "né 漢字 🙂 ▁ \x00 <s> <|endoftext|> <0x0A>  double  blanks\n\nlines\n\nlines", "xx", "c", 60),
    (9, "x" * 3000, "en", "c", 3000),
    (10, PASSAGE + " first end", "en", "a", 90),
    (11, "another begin " + PASSAGE + " second end é", "en", "a", 90),
    (11, "the same id with another text, " + PASSAGE, "en", "a", 90),
    (12, " ".join(f"w{i % 977}" for i in range(20_000)), "en", "a", 90_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark: SparkSession) -> DataFrame:
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns with names that results use too."""
    docs = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("kept", "n", "row", "k", "m", "post", "cell", "length", "bin", "rank", "text_crc32", "label", "at", "d", "node"):
        docs = docs.selectExpr("*", f"'clash' AS `{name}`")
    return docs


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def complements(power: int) -> tuple[str, str]:
    """Two words of 2**power letters, complements of each other, whose polynomial hashes modulo 2**64 are equal from 2**10 on."""
    bits = [i.bit_count() & 1 for i in range(1 << power)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def plain_near_duplicates(docs: list[tuple[int, str | None]], k: int = 5, percent: int = 85) -> dict[int, int]:
    """Component of every id by comparing all pairs."""
    sets: dict[int, list[frozenset]] = defaultdict(list)
    for i, text in docs:
        sets[i].append(shingle_set(text, k))
    parent = {i: i for i in sets}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def plain_removed(docs: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple[int | None, bytes, bytearray]]:
    """Bytes of every row and which of them are covered by a string that also starts in a lower id."""
    low: dict[bytes, int] = {}
    for i, text in docs:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None and i < low.get(b[k : k + length], i + 1):
                low[b[k : k + length]] = i
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and low[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, b, gone))
    return out


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)

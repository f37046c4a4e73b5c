"""Ranked search against a plain scorer."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import search

from .helpers import DOCS, awkward, docs

ITEMS = "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_all, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n_all) // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_awkward(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    items = [(1, "Lorem ipsum, one ONE one"), (2, None), (3, ""), (4, "no such id, here é日𝒳 x"), (None, "text same id"), (5, "!?")]
    got = found(search.search(awkward(spark), spark.createDataFrame(items, ITEMS)))
    assert got == brute(rows, items)
    none = spark.createDataFrame([], DOCS)
    assert found(search.search(none, spark.createDataFrame(items, ITEMS))) == []
    assert found(search.search(awkward(spark), spark.createDataFrame([], ITEMS))) == []


@pytest.mark.parametrize("size", [search.TILE_ENTRIES, 7])
def test_ties_and_tiles(spark, size, monkeypatch):
    """Many documents of one score; several item tiles, and tiles of few rows and columns."""
    monkeypatch.setattr(search, "TERM_COLUMNS", 3)
    monkeypatch.setattr(search, "ITEM_ROWS", 2)
    monkeypatch.setattr(search, "DOC_COLUMNS", 16)
    texts = [f"alpha beta w{k % 7} w{k % 3} " * (1 + k % 2) for k in range(300)] + ["alpha"] * 50
    items = [(k, f"alpha w{k} beta w{k} {'gamma ' * k}") for k in range(9)]
    got = found(search.search(docs(spark, texts), spark.createDataFrame(items, ITEMS), tile_entries=size))
    assert got == brute(list(enumerate(texts)), items)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for scale in (10, 1 << 40):
        a = rng.integers(0, scale, (3, 50))
        b = rng.integers(0, 1000, (50, 4))
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a]
        assert search.multiply(a, b).tolist() == want
    assert search.multiply(np.zeros((2, 0), np.int64), np.zeros((0, 3), np.int64)).tolist() == [[0] * 3] * 2


def test_clashing_columns(spark):
    more = [F.lit(1).alias(c) for c in ("item", "term", "times", "n", "at", "tf", "score", "rank", "part", "r")]
    items = spark.createDataFrame([(1, "one lorem")], ITEMS).select("*", *more)
    assert found(search.search(awkward(spark).select("*", *more), items)) == brute(
        [(r.doc_id, r.text) for r in awkward(spark).collect()], [(1, "one lorem")])

"""Decontamination against a plain search for spans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate as dec

from .helpers import DOCS, awkward, docs

ITEMS = "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    spans = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for k in range(max(len(w) - 9, 1)):
                spans.setdefault(tuple(w[k:k + 10]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, held = words(text), set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                got = spans.get(tuple(w[k:k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    held |= got
        out.append((i, len(w), len(hit), tuple(sorted(held))))
    return sorted(out, key=str)


def found(rows, items):
    got = dec.contaminated(rows, items)
    got = got.select("doc_id", "n_words", dec.covered(F.col("spans")).alias("n_hit"), "items")
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()), key=str)


@pytest.mark.parametrize("sent", [dec.SENT, -1])
def test_random_texts(spark, sent, monkeypatch):
    """Few different words, so that grams and spans repeat, with broadcasts and without; items shorter than a span."""
    monkeypatch.setattr(dec, "SENT", sent)
    monkeypatch.setattr(dec, "SENT_SPANS", sent)
    rng = random.Random(5)
    make = lambda n, m: " ".join(rng.choice("ab cd ef gh ij kl".split()[:m]) for _ in range(n))
    items = [(k, make(rng.randint(8, 30), 2 + k % 5)) for k in range(30)] + [(30, "ab " * 40), (31, make(3, 6)), (32, None),
             (33, "?!"), (None, make(20, 2)), (34, items_text := make(12, 6)), (35, items_text)]
    texts = [make(rng.randint(0, 60), 2 + k % 5) for k in range(150)] + ["Ab. " * 90, None, "", items_text.upper() + " x"] * 2
    assert found(docs(spark, texts), spark.createDataFrame(items, ITEMS)) == brute(list(enumerate(texts)), items)


def test_awkward_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    items = [(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (2, "one"), (3, "é日𝒳")]
    items_df = spark.createDataFrame(items, ITEMS)
    assert found(awkward(spark), items_df) == brute(rows, items)
    assert found(spark.createDataFrame([], DOCS), items_df) == []
    assert found(awkward(spark), spark.createDataFrame([], ITEMS)) == brute(rows, [])


def test_clashing_columns(spark):
    more = [F.lit(1).alias(c) for c in ("_d", "_t1", "_x", "_h", "_at", "_w", "_n", "row", "hits", "place", "length",
                                        "print", "copies", "words", "items", "item", "h", "s")]
    items = spark.createDataFrame([(1, "one")], ITEMS)
    assert found(awkward(spark).select("*", *more), items.select("*", *more)) == found(awkward(spark), items)


def test_every_shared_span_shares_a_fingerprint(spark):
    """Texts of one shared span of exactly ten words amid other words."""
    rng = random.Random(9)
    span = [f"s{k}" for k in range(10)]
    texts = [" ".join([f"a{rng.random()}" for _ in range(rng.randint(0, 9))] + span + [f"b{rng.random()}" for _ in range(rng.randint(0, 9))])
             for _ in range(200)]
    got = found(docs(spark, texts), spark.createDataFrame([(7, "x " + " ".join(span) + " y")], ITEMS))
    assert all(r[2:] == (10, (7,)) for r in got) and len(got) == 200

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import packing

from .helpers import awkward, docs, stored

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_as_the_library(library):
    rng, words = random.Random(5), packing.WordTokens(PATH)
    chars = "aabcdeTH 's't'll\n\t 019.,!|-éÉßΣςσİñ日ǅ́\u0085\xa0 \x1c\x00\x7f<|endoftext|>"
    for k in range(4000):
        s = "".join(rng.choice(chars) if k % 4 else chr(rng.randrange(0x3000)) for _ in range(rng.randrange(30)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert words.encode(s) == np.array(ids, "<u4").tobytes(), repr(s)


def check(rows, texts, library, length=packing.SEQUENCE):
    """Whole pieces, gapless places, no overfull sequence; returns sequences used and the least possible."""
    got = sorted(tuple(r)[:5] for r in rows)
    want = []
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k // length, k, len(ids[k:k + length]), zlib.crc32(ids[k:k + length].tobytes()))
                 for k in range(0, len(ids), length)]
    assert got == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(places), -(-sum(w[3] for w in want) // length)


def test_rows(spark, tmp_path, library):
    df = stored(awkward(spark).filter("doc_id IS NOT NULL").withColumn("offset", F.lit("x")), tmp_path)
    used, least = check(packing.pack_documents(df).collect(), [(r.doc_id, r.text) for r in df.collect()], library)
    assert used <= least + 1
    nulls = stored(awkward(spark).filter("doc_id IS NULL"), tmp_path, "nulls")
    assert packing.pack_documents(nulls).count() == 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_groups_stay_small_and_full(spark, tmp_path, library):
    rng = random.Random(8)
    texts = [" ".join("word" for _ in range(rng.randrange(1, 3000))) for _ in range(400)]
    df = stored(docs(spark, texts), tmp_path)
    pieces = stored(packing.pieces_of(df, PATH, keep_ids=True), tmp_path, "pieces")
    out = packing.pack(pieces, group_pieces=100)
    assert out.select(F.shiftright("sequence_id", 32)).distinct().count() > 2
    used, least = check(out.drop("ids").collect(), list(enumerate(texts)), library)
    assert used <= 1.05 * least
    assert out.filter(F.size("ids") != F.col("length")).count() == 0


def test_local_search_empties_bins():
    sizes = np.array([6, 4, 5, 5, 7, 3, 6, 2, 2, 5, 5])
    bins = [[0], [1, 2], [3, 6 - 1], [4], [6], [7, 8], [9], [10]]
    before = len(bins)
    out = packing.local_search([list(b) for b in bins], sizes, 10)
    assert sorted(k for b in out for k in b) == list(range(11))
    assert all(sizes[b].sum() <= 10 for b in out) and len(out) <= 6 < before


def test_two_for_one_swaps():
    # No move or one-for-one swap helps: 6 goes where 3 and 2 were.
    sizes = np.array([6, 3, 2, 4, 1])
    pick = packing._give([0], [1, 2, 3], 1, sizes)
    assert (pick[0], sorted(pick[1])) == ([0], [1, 2])


def test_added_tokens_as_the_library_by_default(spark, tmp_path):
    default, rng, words = Tokenizer.from_file(PATH), random.Random(6), packing.WordTokens(PATH)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "Hello", "'s", "é", "日", "9"]
    texts = ["hello <|endoftext|> world"] + ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2000)]
    for s in texts:
        ids = default.encode(s, add_special_tokens=False).ids
        assert words.encode(s) == np.array(ids, "<u4").tobytes(), repr(s)
    assert words.encode(texts[0]) == np.array([3306, 49407, 1002], "<u4").tobytes()
    df = stored(docs(spark, texts[:50]), tmp_path)
    check(packing.pack_documents(df).collect(), list(enumerate(texts[:50])), default)

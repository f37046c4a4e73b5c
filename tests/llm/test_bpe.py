import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import bpe

from .helpers import awkward

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(enc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_random_texts_as_the_library(enc, library):
    rng = random.Random(1)
    chars = "aaabbcde  \n\n'stTH .,!é日本𝒳́\t\x1c\xa01234|"
    for _ in range(3000):
        s = "".join(rng.choice(chars) for _ in range(rng.randrange(40)))
        assert enc.encode(s) == library.encode_ordinary(s), repr(s)


def test_very_long_match(enc, library):
    s = "ab" * 20_000 + " " * 5000 + "x"
    assert enc.encode(s) == library.encode_ordinary(s)


def test_pairs_agree_with_plain_merging(enc):
    rng = random.Random(2)
    for _ in range(3000):
        a, b = rng.randrange(len(enc.ranks)), rng.randrange(len(enc.ranks))
        x, y = enc.tokens[a], enc.tokens[b]
        assert enc.may_follow(a, b) == (bpe.merge_all(x + y, enc.ranks) == [x, y])


@settings(max_examples=150, deadline=None)
@given(st.text("abcdeth ing", max_size=60), st.data())
def test_table_appends_and_edits(text, data):
    enc = bpe.encoder(PATH, P.PATTERN)
    raw = text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    t = bpe.PrefixTable(enc, raw[:cut])
    t.append(raw[cut:])
    plain = lambda b: [enc.ranks[x] for x in bpe.merge_all(b, enc.ranks)] if b else []
    assert t.ids() == plain(raw)
    assert t.ids(cut) == plain(raw[:cut])  # every prefix has its encoding
    start = data.draw(st.integers(0, len(raw)))
    end = data.draw(st.integers(start, len(raw)))
    new = data.draw(st.text("abcth", max_size=8)).encode()
    t.replace(start, end, new)
    assert t.data == raw[:start] + new + raw[end:]
    assert t.ids() == plain(t.data)


def test_edit_is_local(enc):
    t = bpe.PrefixTable(enc, b"the quick brown fox jumps over the lazy dog " * 200)
    assert t.replace(20, 23, b"cat") < 400


def test_rows(spark, library):
    df = awkward(spark).withColumns({"n_tokens": F.lit("old"), "ids": F.lit(0)})
    got = bpe.encode_decode(df, PATH, P.PATTERN).collect()
    assert len(got) == df.count()
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH, P.PATTERN).count() == 0

import hashlib
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from ledgerlake.llm import fingerprint

from .helpers import awkward, docs, stored


def picked(w):
    return (xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % 8 == 0  # a signed number's residue is the same


def parts(t):
    """The rule, restated: sentence and line ends, and in a stretch, words (characters of long words) that a hash picks."""
    for end in "。！？":
        t = t.replace(end, end + "\n")
    out = set()
    for p in regex.split("\n|(?<=[.!?…؟۔।]) |(?<=[.!?…؟۔।][\"'”’)\\]]) ", t):
        words = [("".join(c + "\n" * picked(c) for c in w) if len(w) > 32 else w + "\n" * picked(w)) for w in p[96:].split(" ")]
        out.update(regex.split("\n ?", p[:96] + " ".join(words)) if len(p) > 96 else [p])
    return out - {""}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, order):
    rows = sorted(rows, key=order)
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(parts(t), parts(e)), 9),
                    round(alike(parts(t), parts(following)), 9)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in fingerprint.fingerprints(df).collect()), key=str)


@pytest.mark.parametrize("range_rows", [4096, 7])
def test_as_brute_force(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    rng = random.Random(9)
    lines = [f"line {k} ends in a word. Then it goes on about {k}" for k in range(400)]
    texts = ["\n".join(rng.sample(lines, rng.choice([0, 1, 3, 9, 40, 300]))) for _ in range(90)]
    texts[5:9] = [None, "", "é𝒳日" * 7, texts[0]]
    word = lambda: "".join(rng.choice("aeinorsy") for _ in range(rng.randrange(1, 9)))
    for k in range(10, 20):  # stretches without an end, words that are long, ends without a space
        texts[k] = " ".join(word() for _ in range(150)) + ("。" + "日é" * 40) * (k % 3) + " " * (k % 4) + "\n" + texts[k]
    df = stored(docs(spark, texts), tmp_path)
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()], lambda x: -x[0])


def test_equal_texts_have_equal_fingerprints(spark, tmp_path):
    df = stored(docs(spark, ["a b\nc d", "x\ny", "a b\nc d", None, ""]), tmp_path)
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert got[0] == got[2] != got[1] and got[3] == got[4]


def test_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    df = stored(awkward(spark).withColumns({"row": F.lit("x"), "a": F.lit(1)}), tmp_path)
    assert fingerprint.fingerprints(df).count() == df.count()
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]])
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()], order)
    assert run(df.limit(0)) == []
    one = stored(docs(spark, ["only one. text"]), tmp_path, "one")
    assert run(one) == brute([(0, "only one. text")], lambda x: x[0])


def test_peeling_recovers_differences_and_retries(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    sets = [(rng.sample(range(2000), rng.choice([0, 1, 20, 500])), rng.sample(range(2000), rng.choice([0, 1, 20, 500]))) for _ in range(60)]
    sets += [([5, 6], [6, 5]), (list(range(900)), list(range(1, 900)))]
    digest = F.transform("d", lambda x: F.shiftleft(F.xxhash64(x), 16))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sets)], "row long, a array<long>, b array<long>").withColumn("of", F.lit(0))
    for c in "ab":
        df = df.withColumn("d", F.col(c)).withColumn(c, F.transform(digest, lambda d: d.bitwiseOR(fingerprint._check(d))))
    df = stored(df.drop("d"), tmp_path, "pairs")
    want = {k: alike(set(a), set(b)) for k, (a, b) in enumerate(sets)}
    for space, rounds in ((2, 4), (1, 1)):  # the second cannot peel most pairs at first
        monkeypatch.setattr(fingerprint, "SPACE", space)
        monkeypatch.setattr(fingerprint, "ROUNDS", rounds)
        got = {r.row: r.near for r in fingerprint.compare(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r.row: (r.plus, r.minus, r.left) for r in fingerprint.peeled(df, 3).collect()}
    assert 60 not in left and left[61] == (1, 0, 0)


def test_half_edited_texts_of_one_line_are_alike(spark, tmp_path):
    rng = random.Random(4)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    han = [chr(0x4E00 + k) for k in range(900)]
    texts = []
    for k in range(40):
        words = [word("aeinorsy", rng.randrange(2, 9)) for _ in range(400)]
        texts += [" ".join(w + rng.choice(".!?") * (k % 7 == 0) for k, w in enumerate(words)),
                  " ".join(words), word(han, 800), "。".join(word(han, 12) for _ in range(60))]
    rows = fingerprint.fingerprints(stored(docs(spark, texts), tmp_path)).collect()
    for kind in range(4):
        near = [r.near_edited for r in rows if r.doc_id % 4 == kind]
        assert min(near) > 0.1 and sum(near) / len(near) > 0.2, kind
    assert max(r.near_next for r in rows) < 0.1


def test_every_sentence_end_cuts(spark):
    text = 'One a. Two b! "Three c." Four d? Five e\nsix 3.5 g. '
    got = spark.range(1).select(fingerprint.paragraphs(F.lit(text)).alias("p")).first().p
    assert got == ["One a.", "Two b!", '"Three c."', "Four d?", "Five e", "six 3.5 g."]


def test_texts_are_shuffled_without_their_digests(spark, tmp_path):
    df = stored(docs(spark, [f"One {k}. Two {k}.\nThree." for k in range(50)]), tmp_path)
    plan = fingerprint.with_next(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.splitlines() if "array_distinct" in line or "Exchange hashpartitioning(_part" in line]
    assert len([n for n in nodes if "Exchange" in n]) == 1
    assert "Exchange" in nodes[-1]  # the plan's last lines run first


def test_all_rows_are_shuffled_once(spark, tmp_path):
    df = stored(docs(spark, [f"One {k}. Two {k}.\nThree." for k in range(50)]), tmp_path)
    rows = fingerprint.with_next(df, "doc_id", "text")
    rows = rows.select("_part", F.monotonically_increasing_id().alias("row"), "a", fingerprint.digests(F.col("next_text")).alias("b"), "c")
    plan = fingerprint.sketched(fingerprint.compared(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(_part") == 1
    out = fingerprint.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert out.count("Exchange ") == out.count("Join") == 0  # none is tried again


def test_rows_tried_again_keep_their_fingerprints(spark, tmp_path, monkeypatch):
    df = stored(docs(spark, ["\n".join(f"line {i % (k + 7)} of {k}" for i in range(60)) for k in range(12)]), tmp_path)
    want = sorted(map(tuple, fingerprint.fingerprints(df).collect()))
    monkeypatch.setattr(fingerprint, "SPACE", 1)
    monkeypatch.setattr(fingerprint, "ROUNDS", 1)  # most are not peeled at first
    assert sorted(map(tuple, fingerprint.fingerprints(df).collect())) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 50])
def test_ranges_are_counts_of_bounds(spark, n):
    bounds = sorted(random.Random(n).sample(range(-100, 100), n))
    got = spark.range(-105, 105).select("id", fingerprint._range(F.col("id"), bounds).alias("p")).collect()
    assert all(r.p == sum(b <= r.id for b in bounds) for r in got)

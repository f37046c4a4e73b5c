import collections
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import near_dup
from ledgerlake.llm.components import components

from .helpers import awkward, docs, stored


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(*[w[k:] for k in range(5)]))


def brute(rows):
    """Component of each row: links on full sets between all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= 75 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, t) in enumerate(rows):
        c = min(least[find(k)], default=None) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in near_dup.near_duplicates(df, **kw).collect()), key=str)


def corpus(rng, copies):
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for k in range(copies):  # one large group of near copies, some too far from the rest
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    shared = " ".join(rng.choice(words) for _ in range(20))  # a passage that many texts hold
    texts += [" ".join(rng.choice(words) for _ in range(30)) + " " + shared for _ in range(60)]
    texts += ["Exact  COPY of one text, word for word"] * 40
    texts += ["a a a a a", "A a a a a a", "a a a a", "two words", "Two\tWords", ""]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("region,block", [(1024, 256), (8, 7)])
def test_as_brute_force(spark, tmp_path, region, block):
    df = stored(docs(spark, corpus(random.Random(6), 150)), tmp_path)
    assert run(df, region=region, block=block) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_awkward_rows(spark, tmp_path):
    df = stored(awkward(spark).withColumns({"node": F.lit(1), "kept": F.lit("x")}), tmp_path)
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert run(df.limit(0)) == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5000, 5000)]
    rng = random.Random(7)
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(80)}}

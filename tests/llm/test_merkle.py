"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import merkle

from .helpers import DOCS, awkward, stored


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root, and siblings with their sides for each leaf."""
    paths, now = [[] for _ in leaves], leaves
    at = list(range(len(leaves)))
    while len(now) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(now):
                paths[k].append(("L" if i & 1 else "R") + now[i ^ 1])
            else:
                paths[k].append("-")
        now = [sha("".join(now[i:i + 2])) for i in range(0, len(now), 2)]
        at = [i // 2 for i in at]
    return now[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], leaf_of((r[0], r[3], r[2], r[4], r[1])), r))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    done = {n: tree([x[1] for x in sorted(trees[n], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for n in names}
    root, above = tree([done[n][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for (i, leaf, r), path in zip(sorted(trees[n], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), done[n][1], strict=True):
            path = path + above[k]
            now = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[4] is not None:
                now = leaf_of((i, r[3], n, r[4] + 1, r[1]))
            for s in path:
                now = sha(now if s == "-" else s[1:] + now if s[0] == "L" else now + s[1:])
            out.append((i, leaf, done[n][0], root, sha("".join(s[1:] for s in path)), now, now == root))
    return sorted(out, key=str)


def query(spark, docs, tmp_path):
    stored(docs, tmp_path, "documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_awkward_rows(spark, tmp_path):
    rows = [tuple(r) for r in awkward(spark).collect()]
    assert query(spark, awkward(spark), tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 255, 257, 1300])
def test_blocks(spark, tmp_path, n):
    """One tree holds most rows and is several blocks, the last of them partly filled."""
    rows = [(3 * k, f"text {k}", "en" if k % 10 else ("é", "a", None)[k // 10 % 3], "s", k) for k in range(n)]
    assert query(spark, spark.createDataFrame(rows, DOCS), tmp_path) == brute(rows)


def test_many_trees_and_empty(spark, tmp_path):
    rows = [(k, "x", f"l{k % 300}", None, 1) for k in range(900)]
    assert query(spark, spark.createDataFrame(rows, DOCS), tmp_path / "a") == brute(rows)
    assert query(spark, spark.createDataFrame([], DOCS), tmp_path / "b") == []


def test_clashing_columns(spark, tmp_path):
    docs = awkward(spark).select("*", *[F.lit(1).alias(c) for c in (
        "t", "id", "digest", "part", "place", "rank", "n", "block", "proof", "root", "subroot", "leaf", "tree", "name")])
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    out = merkle.manifest(docs, fields, also={"root": F.col("n"), "t": F.col("text")})
    assert out.columns == ["id", "tree", "leaf", "subroot", "root", "proof", "root", "t"]
    assert out.count() == docs.count()


def test_sweeps_deliver_every_sibling():
    digests = [sha(str(k)) for k in range(200)]
    nodes = merkle.forward(digests, 8)
    assert nodes[8, 0] == tree(digests)[0]
    found = merkle.reversed_sweep(nodes, 8, ["Lx"])
    assert [found[k] for k in range(200)] == [p + ["Lx"] for p in tree(digests)[1]]

"""MinHash near-dedup with an LSH forest.

A text's words (A-Z lower-cased) give its set of distinct 5-word shingles.
Texts with the same words are one node from the start.  A node's signature
is ``TREES`` x ``DEPTH`` min-hashes; each tree is one order of the nodes, by its
own ``DEPTH`` min-hashes.  Neighbours in an order that share the longest
prefixes are candidates: a region is a shared prefix of ``MIN_DEPTH`` hashes,
made one hash deeper as long as it holds more than ``REGION`` nodes.  A pair
of Jaccard similarity 0.75 shares a prefix of 3 in one of 16 trees with
probability 0.9998.  A region still too large at full depth is cut into
blocks, and every pair of blocks is compared, so nothing is capped.

Inside regions, whole signatures are compared; pairs that agree in fewer than
``LIKELY`` of the hashes are let go (a similar pair would have to be 4.5 standard
deviations off).  What remains joins nodes to candidate clusters.  A cluster's
texts are then brought together once, in blocks, and links are confirmed on
full shingle sets.  Only a spanning set of links leaves a block, so a group
of thousands of copies gives thousands of rows, not millions.

Defined results: null, empty or blank text: no shingles, linked with nothing;
fewer than five words: the whole sequence is the one shingle; copies of a
text are linked; every row is returned, also repeated ones; rows of one
``doc_id`` with different texts are separate nodes; a null ``doc_id`` is never
the smallest id of a group, and a group of null ids only has a null
``component_id`` (``kept`` is true); other columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read, stored
from .components import components

WORDS = 5
SIMILAR = 0.75
TREES, DEPTH, MIN_DEPTH = 16, 6, 3
HASHES = TREES * DEPTH
REGION = 1024
BLOCK = 256
LIKELY = 0.55
MAX_KNOWN = 500_000  # remembered word hashes per worker

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= MAX_KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (``[\\x20\\x09-\\x0D]``), A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """The distinct shingles, as sorted 64-bit hashes."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    count = len(words) - n + 1
    h = np.zeros(count, np.uint64) + np.uint64(n)
    for k in range(n):
        h = h * _P + w[k:k + count]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        block = _A[:, None] * shingles[None, at:at + 1024]
        block += _B[:, None]
        np.minimum(least, block.min(1), out=least)
    return ((least * _P) >> np.uint64(48)).astype("<u2")


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, node (hash of its words; null without any), set size, signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, sig = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                s = shingle_hashes(words)
                size.append(len(s))
                node.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sig.append(signature(s).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(node, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(sig, pa.binary())], names=["doc_id", "raw", "node", "n_shingles", "sig"])
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col,
                                 F.xxhash64(text_col).alias("raw")), run,
                     "doc_id long, raw long, node binary, n_shingles long, sig binary")


def prefixes(nodes: DataFrame) -> DataFrame:
    """One row per node and tree: the hashed prefixes of every depth from ``MIN_DEPTH``."""
    depths = list(range(MIN_DEPTH, DEPTH + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(n, TREES, DEPTH).astype(np.uint64)
            key = np.zeros((n, TREES), np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
            out = []
            for d in range(DEPTH):
                key = (key * _P) ^ (sig[:, :, d] + np.uint64(d + 1))
                key ^= key >> np.uint64(32)
                if d + 1 >= MIN_DEPTH:
                    out.append(pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))] + out,
                                             names=["node", *(f"k{d}" for d in depths)])

    return map_arrow(nodes.select("node", "sig"), run, "node binary, " + ", ".join(f"k{d} long" for d in depths))


def regions(nodes: DataFrame, region: int) -> DataFrame:
    """``node``, ``region``, ``members`` of the regions of two nodes or more."""
    left, found = prefixes(nodes), None
    for d in range(MIN_DEPTH, DEPTH + 1):
        sizes = left.groupBy(f"k{d}").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        left = stored(left.join(sizes, f"k{d}"), f"depth{d}")
        last = d == DEPTH
        fit = left if last else left.filter(F.col("members") <= region)
        fit = fit.select("node", F.col(f"k{d}").alias("region"), "members")
        found = fit if found is None else found.unionAll(fit)
        if last or left.filter(F.col("members") > region).isEmpty():
            return found
        left = left.filter(F.col("members") > region).drop("members")


def block_pairs(members: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of a group dealt to units: blocks of about ``block`` rows, each pair of blocks together.

    ``unit`` is the group and the pair; ``side`` is 0 for a pair's first block."""
    blocks = F.ceil(F.col("members") / block).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("_n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return (members.withColumn("_n", blocks).withColumn("_own", own).withColumn("_other", other)
            .withColumn("unit", F.struct(group, F.least("_own", "_other").alias("x"),
                                         F.greatest("_own", "_other").alias("y")))
            .withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
            .drop("_n", "_own", "_other", "members"))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the least row it is linked with over pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _units(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Whole units of a stream that is sorted by unit."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        units = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != units[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()),
                                       pa.array([e[1] for e in edges], pa.binary())], names=["a", "b"])


def likely_links(dealt: DataFrame) -> DataFrame:
    """A spanning set of the pairs of each unit whose signatures agree enough."""
    need = int(np.ceil(LIKELY * HASHES))

    def links(sig: np.ndarray, unit: np.ndarray, side: np.ndarray, paired: np.ndarray) -> tuple:
        a_all, b_all = [], []
        rows, step = np.arange(len(unit)), 1
        while True:  # row i with row i + step of the same unit
            rows = rows[rows + step < len(unit)]
            rows = rows[unit[rows] == unit[rows + step]]
            if not len(rows):
                break
            todo = rows[~paired[rows] | (side[rows] != side[rows + step])]
            for at in range(0, len(todo), 1 << 15):
                part = todo[at:at + (1 << 15)]
                hit = (sig[part] == sig[part + step]).sum(1) >= need
                a_all.append(part[hit])
                b_all.append(part[hit] + step)
            step += 1
        return (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (rows, rows)

    def solve(t: pa.Table) -> pa.RecordBatch:
        nodes = t.column("node").to_pylist()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(nodes), HASHES)
        a, b = links(sig, t.column("u").to_numpy(), t.column("side").to_numpy(),
                     t.column("paired").to_numpy())
        label = _spanning(a, b, len(nodes))
        return _edge_batch([(nodes[k], nodes[label[k]]) for k in np.flatnonzero(label != np.arange(len(nodes)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for unit in _units(batches, 0):  # small units are compared together
            held.append(unit)
            n += unit.num_rows
            if n >= 8192:
                yield solve(pa.concat_tables(held))
                held, n = [], 0
        if held:
            yield solve(pa.concat_tables(held))

    rows = (dealt.select(F.xxhash64("unit").alias("u"), "node", "sig", "side",
                         (F.col("unit.x") != F.col("unit.y")).alias("paired"))
            .repartition("u").sortWithinPartitions("u"))
    return map_arrow(rows, run, "a binary, b binary")


def confirm(sets: list[np.ndarray], side: np.ndarray | None, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (of different sides, if given) at least ``similar``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat, inv = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inv, kind="stable")
    holders = owner[order]
    ptr = np.concatenate(([0], np.cumsum(np.bincount(inv, minlength=len(flat)))))
    at, a_all, b_all = 0, [], []
    for i in range(len(sets) - 1):
        cols = inv[at:at + size[i]]
        at += size[i]
        lens = ptr[cols + 1] - ptr[cols]
        idx = np.repeat(ptr[cols] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        both = np.bincount(holders[idx], minlength=len(sets))[i + 1:]
        ok = 100 * both >= round(100 * similar) * (size[i] + size[i + 1:] - both)
        if side is not None:
            ok &= side[i + 1:] != side[i]
        js = np.flatnonzero(ok) + i + 1
        a_all.append(np.full(len(js), i))
        b_all.append(js)
    return np.concatenate(a_all), np.concatenate(b_all)


def confirmed_links(dealt: DataFrame, similar: float) -> DataFrame:
    """A spanning set of the confirmed links of each unit of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for t in _units(batches, 0):
            if t.num_rows < 2:
                continue
            nodes, side = t.column("node").to_pylist(), t.column("side").to_numpy()
            sets = [shingle_hashes(words_of(x.as_py())) for x in t.column("text")]
            paired = t.column("paired")[0].as_py()
            a, b = confirm(sets, side if paired else None, similar)
            label = _spanning(a, b, len(nodes))
            out += [(nodes[k], nodes[label[k]]) for k in np.flatnonzero(label != np.arange(len(nodes)))]
            if len(out) > 50_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    rows = (dealt.select(F.xxhash64("unit").alias("u"), "node", "text", "side",
                         (F.col("unit.x") != F.col("unit.y")).alias("paired"))
            .repartition("u").sortWithinPartitions("u"))
    return map_arrow(rows, run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similar: float = SIMILAR, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of a stored table."""
    rows = stored(sketch(docs, id_col, text_col), "sketch")
    nodes = (rows.filter("node IS NOT NULL").groupBy("node")
             .agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "raw")).alias("src"),
                  F.min("sig").alias("sig")))
    nodes = stored(nodes, "nodes")

    near = regions(nodes, region).join(nodes.select("node", "sig"), "node")
    clusters = components(likely_links(block_pairs(near, "region", region)))
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    members = (clusters.join(sizes, "label").join(nodes.select("node", "src"), "node")
               .select("label", "members", "node", F.col("src.doc_id").alias("_id"), F.col("src.raw").alias("_raw")))
    # One text of each node; ids may be null or repeat with other texts.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("raw"),
                        F.col(text_col).alias("text"))
    with_text = (members.join(texts, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_raw") == F.col("raw")))
                 .select("label", "members", "node", "text"))
    links = confirmed_links(block_pairs(with_text, "label", block), similar)

    groups = components(links)
    labelled = (nodes.select("node", "first").join(groups, "node", "left")
                .select("node", "first", F.coalesce("label", "node").alias("label")))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = labelled.join(least, "label").select("node", "component_id")
    return (rows.select("doc_id", "node", "n_shingles").join(by_node, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op6_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers, floor(64 x).  Largest inner product is nearest
neighbour once every data vector gets one more component that makes all of
them equally long (queries get 0 there).  Pivots from a bounded sample part
the space: data and queries go to their nearest pivot.  From the cells'
summaries (the farthest query, and the few nearest data vectors, of each)
follows a distance within which every query of a cell has its k neighbours; by
the triangle inequality a data vector is sent only to the query cells it may
matter to.  Cells are cut into blocks, so a task holds ``QUERY_BLOCK`` queries
and about ``DATA_BLOCK`` vectors, however many equal vectors there are; a
task's best k a query are merged at the end.

What reaches the driver: ``PIVOT_SAMPLE`` vectors and, for each of at most
``MAX_PIVOTS`` cells, two counts and k + 2 distances.

Defined results: a null vector, or one with a null, non-finite or (its score
would not fit a long) over 2^20 large component, takes no part, nor does a
null id; a shorter vector is filled up with zeros; a repeated id counts once,
with the smallest of its vectors; equal scores go by smaller id; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import group_arrow, map_arrow, read, stored

SCALE = 64.0
LARGEST = float(1 << 20)
PIVOT_SAMPLE = 2048
MAX_PIVOTS = 256
QUERY_BLOCK = 512
DATA_BLOCK = 8192
SLACK = 1e-6  # for rounding in distances


def _matrix(cells: pa.Array, dims: int) -> np.ndarray:
    """The integer vectors of a binary column as rows of doubles."""
    return np.frombuffer(b"".join(cells.to_pylist()), "<i4").reshape(-1, dims).astype(np.float64)


def integer_vectors(vecs: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``id`` and ``v`` (array of long) of the rows that take part, each id once."""
    x = F.col(vec_col)
    fits = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    return (vecs.filter(fits)
            .select(F.col(id_col).alias("id"),
                    F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _packed(vectors: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = []
            for x in b.column(1):
                row = np.zeros(dims, "<i4")
                own = x.values.to_numpy()
                row[:len(own)] = own
                v.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(v, pa.binary())],
                                             names=["id", "is_query", "v"])
    return map_arrow(vectors, run, "id long, is_query boolean, v binary")


def _lift(x: np.ndarray, length2: float) -> np.ndarray:
    """Data vectors with the component that makes them all equally long."""
    more = np.sqrt(np.maximum(0.0, length2 - (x * x).sum(1)))
    return np.column_stack((x, more))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d2))


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Sample vectors far from each other (equal ones only once)."""
    picked = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(picked) < count and near.max() > 1e-3:
        k = int(near.argmax())
        picked.append(k)
        near = np.minimum(near, _distances(sample, sample[k:k + 1])[:, 0])
    return sample[picked]


def top_k(vecs: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; ``is_query`` is over ``id``."""
    vectors = stored(integer_vectors(vecs, id_col, vec_col, scale).withColumn("is_query", is_query), "vectors")
    empty = "query_id long, rank int, vec_id long, score long"
    zero = F.lit(0).cast("long")
    found = vectors.agg(
        F.max(F.size("v")).alias("dims"), F.count_if("is_query").alias("queries"),
        F.max(F.aggregate("v", zero, lambda s, c: s + c * c)).alias("length2"),
        F.max(F.aggregate("v", zero, lambda s, c: F.greatest(s, F.abs(c)))).alias("widest")).first()
    if not found["queries"] or found["dims"] is None:
        return vecs.sparkSession.createDataFrame([], empty)
    dims, length2 = max(1, found["dims"]), float(found["length2"])
    exact = found["widest"] ** 2 * dims < 2 ** 53  # products and sums are whole in doubles
    packed = _packed(vectors.select("id", "v", "is_query"), dims)

    sample = _packed(vectors.select("id", "v", "is_query")
                     .orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE), dims).collect()
    sample.sort(key=lambda r: r["id"])
    wanted = min(MAX_PIVOTS, max(8, -(-found["queries"] // QUERY_BLOCK)))
    pivots = _pivots(_lift(np.stack([np.frombuffer(r["v"], "<i4").astype(np.float64) for r in sample]),
                           length2), wanted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2), dims)
            d = _distances(_lift(x, length2), pivots)
            q = _distances(np.column_stack((x, np.zeros(len(x)))), pivots)
            at, aq, rows = d.argmin(1), q.argmin(1), np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(at, pa.int32()), pa.array(d[rows, at]),
                 pa.array(aq, pa.int32()), pa.array(q[rows, aq])],
                names=["id", "is_query", "v", "cell", "far", "q_cell", "q_far"])

    assigned = stored(map_arrow(packed, assign, "id long, is_query boolean, v binary, cell int, far double, "
                                                "q_cell int, q_far double"), "assigned")
    nearest = (assigned.select("cell", "far")
               .withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far")))
               .filter(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list("far").alias("near")))
    data = {r["cell"]: r for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
            .join(nearest, "cell").collect()}
    asked = {r["q_cell"]: r for r in assigned.filter("is_query").groupBy("q_cell")
             .agg(F.count(F.lit(1)).alias("n"), F.max("q_far").alias("far")).collect()}

    between = _distances(pivots, pivots)
    least = np.full((len(pivots), len(pivots)), np.inf)  # by query cell and data cell: how far out rows matter
    for i, q in asked.items():
        reach = np.sort(np.concatenate([between[i, j] + np.array(c["near"]) for j, c in data.items()]))
        bound = q["far"] + reach[k] if len(reach) > k else np.inf  # one of the k + 1 may be the query itself
        least[i] = between[i] - q["far"] - bound * (1 + SLACK) - SLACK
    q_blocks = {i: -(-q["n"] // QUERY_BLOCK) for i, q in asked.items()}
    d_blocks = {j: -(-c["n"] // DATA_BLOCK) for j, c in data.items()}

    def spread(ids: np.ndarray, blocks: int) -> np.ndarray:
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) % np.uint64(max(1, blocks))).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q", "d", "as_query", "id", "v"]
        for b in batches:
            ids = b.column(0).to_numpy()
            cell, far = b.column(3).to_numpy(), b.column(4).to_numpy()
            is_q, q_cell = b.column(1).to_numpy(zero_copy_only=False), b.column(5).to_numpy()
            for i in asked:
                own = np.flatnonzero(is_q & (q_cell == i))
                sub_q = spread(ids[own], q_blocks[i])
                for j in data:
                    # Queries go to every block of a cell that sends them data.
                    if len(own) and least[i, j] < np.inf:
                        for c in range(d_blocks[j]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(i * (1 << 20) + sub_q), pa.array(np.full(len(own), j * (1 << 20) + c)),
                                 pa.array(np.ones(len(own), bool)), b.column(0).take(pa.array(own)),
                                 b.column(2).take(pa.array(own))], names=names)
                    rows = np.flatnonzero((cell == j) & (far >= least[i, j]))
                    if len(rows):
                        part = pa.array(j * (1 << 20) + spread(ids[rows], d_blocks[j]))
                        for s in range(q_blocks[i]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(rows), i * (1 << 20) + s)), part,
                                 pa.array(np.zeros(len(rows), bool)), b.column(0).take(pa.array(rows)),
                                 b.column(2).take(pa.array(rows))], names=names)

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        ask = t.column("as_query").to_numpy()
        ids = t.column("id").to_numpy()
        raw = np.frombuffer(b"".join(t.column("v").to_pylist()), "<i4").reshape(-1, dims)
        raw = raw.astype(np.float64 if exact else np.int64)
        out: list[tuple] = []
        d_ids, d_rows = ids[~ask], raw[~ask]
        if len(d_ids):
            order = np.argsort(d_ids, kind="stable")
            d_ids, d_rows = d_ids[order], d_rows[order]
            for q_id, row in zip(ids[ask], raw[ask]):
                s = d_rows @ row
                s[d_ids == q_id] = np.iinfo(np.int64).min if not exact else -np.inf
                n = min(k, len(s) - int((d_ids == q_id).any()))
                if n <= 0:
                    continue
                cut = np.partition(s, len(s) - n)[len(s) - n]
                best = np.flatnonzero(s >= cut)
                best = best[np.argsort(-s[best], kind="stable")][:n]
                out.append((np.full(n, q_id), d_ids[best], s[best].astype(np.int64)))
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(3)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    dealt = map_arrow(assigned, deal, "q long, d long, as_query boolean, id long, v binary")
    found = group_arrow(dealt, ["q", "d"], solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= 20
"""

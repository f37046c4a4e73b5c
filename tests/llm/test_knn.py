import math
import random

from pyspark.sql import functions as F

from ledgerlake.llm import knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    vecs = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(64 * c) for c in v)
        vecs[i] = min(vecs.get(i, x), x)
    out = []
    for q in vecs:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)[:k]
            out += [(q, r + 1, i, -score) for r, (score, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **kw):
    rows = [(i, v and [x if x is None else float(x) for x in v], n) for i, v, n in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "score": F.lit(0)})
    return sorted(tuple(r) for r in knn.top_k(df, F.col("id") % 20 == 0, **kw).collect())


def test_ties_nulls_copies_and_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    f = lambda: rng.randrange(-40, 40) / 32  # noqa: E731  exact in a float
    rows = [(i, [f() for _ in range(6)], 0) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, 0, 0, 0, -1.0], 1) for i in range(150)]  # one common vector, queries among it
    rows += [(5000, None, 0), (5020, [1.0, None, 0, 0, 0, 0], 0), (5040, [float("nan")] * 6, 0),
             (5060, [float("inf")] + [0.0] * 5, 0), (None, [0.0] * 6, 0), (5080, [1.0, 2.0], None),
             (40, [9.0] * 6, 0), rows[7]]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(knn, "DATA_BLOCK", 16)
    rows[40] = (40, [-9.0, 0, 0, 0, 0, 0], 0)  # a repeated id: the smaller vector counts
    assert run(spark, rows) == brute([(i, v + [0.0] * (6 - len(v)) if v else v, x) for i, v, x in rows])


def test_fewer_rows_than_k_and_none(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(0, 60, 20)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0], 0)]) == []
    assert run(spark, [(1, [1.0], 0)]) == []
    assert run(spark, rows[:0]) == []


def test_clustered_data_is_pruned_and_exact(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [(8.0 if i % 8 == d else 0.0) + rng.randrange(16) / 16 for d in range(8)], 0) for i in range(800)]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    assert run(spark, rows, k=5) == brute(rows, 5)

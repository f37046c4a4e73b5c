"""Language ID by nearest centroid.

A text becomes a TF-IDF vector of its letter bigrams and trigrams (hashed to
``DIMS`` buckets, log term counts, length 1).  Every language has several
centroids, found by spherical k-means over a bounded sample of its labelled
texts.  The nearest centroid by cosine names the language; a text too far
from all of them is marked ``rejected``.

Document frequencies are counted over every learnable text.  The model is a
few small arrays: ``DIMS`` weights and ``CLUSTERS`` x ``DIMS`` numbers for a
language.  Every language is learned, each in a task of its own.
What reaches the driver: ``DIMS`` counts, the centroids and, for each language,
at most ``SAMPLE`` cosines.  A size class with too few sampled texts to say what
is usual takes its limit from the nearest class that has enough, lowered for
shorter texts as the cosine of a part falls with the root of its length; if no
class has enough, nothing is rejected for its cosine.

Defined results: null text, or one with no letter: ``und``, score 0,
rejected; every row, also a repeated one, is returned; a null label is not
learned from; with nothing to learn from, all is ``und``; other columns pass
through (input columns named like an output column are replaced); an empty
table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import group_arrow, map_arrow, read, schema_with

DIMS = 2048
CLUSTERS = 4
SAMPLE = 512         # labelled texts a language that centroids are fitted on
ROUNDS = 12          # k-means rounds
SHARPNESS = 25.0     # turns cosines into a score
FAR = 0.5            # a text is rejected under this part of the usual cosine
ENOUGH = 20          # sampled texts of a size class

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's letter n-grams, and how often each occurs."""
    none = np.empty(0, np.int64), np.empty(0, np.float32)
    if not text:
        return none
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    ok = _letters()[a]
    if not ok.any():
        return none
    a = np.where(ok, a, 32).astype(np.uint64)
    a = np.concatenate(([32], a, [32])).astype(np.uint64)
    gap = a == 32
    a = a[~(gap & np.concatenate(([False], gap[:-1])))]
    two = a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA6B)
    three = two[:-1] * np.uint64(0x27D4EB2F) + a[2:] * np.uint64(0xC2B2AE35)
    x = np.concatenate((two, three)) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((x >> np.uint64(40)).astype(np.int64) & (DIMS - 1), minlength=DIMS)
    idx = np.flatnonzero(counts)
    return idx, counts[idx].astype(np.float32)


def tfidf(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[idx]
    n = np.linalg.norm(w)
    return w / n if n else w


def size_class(tf: np.ndarray) -> int:
    return int(np.log2(max(1.0, float(tf.sum()))))


@dataclass
class Model:
    labels: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: dict[int, float] = field(default_factory=dict)  # by size class

    def limit(self, size: int) -> float:
        """The least cosine of a size class, or of the nearest one that has a limit."""
        if not self.least:
            return 0.0
        near = min(self.least, key=lambda s: (abs(s - size), s))
        return self.least[near] * 2.0 ** (min(0, size - near) / 2)

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """Label, score, rejected, cosine."""
        idx, tf = gram_counts(text)
        if not len(idx) or not self.labels:
            return "und", 0.0, True, 0.0
        cosines = self.centroids[:, idx] @ tfidf(idx, tf, self.idf)
        best = np.full(len(self.labels), -1.0)
        np.maximum.at(best, self.owner, cosines)
        k = int(best.argmax())
        p = np.exp(SHARPNESS * (best - best[k]))
        return (self.labels[k], float(1 / p.sum()),
                bool(best[k] < self.limit(size_class(tf))), float(max(0.0, best[k])))


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the vectors farthest from those chosen."""
    centers = [x.mean(0)]
    near = x @ (centers[0] / max(np.linalg.norm(centers[0]), 1e-9))
    picked = [int(near.argmax())]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        new = []
        for j in range(len(c)):
            s = x[own == j].sum(0) if (own == j).any() else c[j]
            new.append(s / max(np.linalg.norm(s), 1e-9))
        c = np.stack(new)
    return c


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and in how many of them each bucket occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                idx, _ = gram_counts(t.as_py())
                n += bool(len(idx))
                df[idx] += 1
        df[DIMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    rows = (map_arrow(docs.select(text_col), run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # DIMS + 1 rows at most
    df = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return int(df[DIMS]), df[:DIMS]


def sample_texts(docs: DataFrame, text_col: str, label_col: str, sample: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``sample`` rows of each label, the same for the same table."""
    # Rows, not texts, are thinned: copies of one text are not all kept or all left out.
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    sizes = docs.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    # Thin every label to about twice the sample first: no window sees a whole label.
    part = F.least(F.lit(1.0), (2.0 * sample + 20.0) / F.col("_n"))
    thin = (docs.join(F.broadcast(sizes), label_col).withColumn("_o", order)
            .filter(F.pmod(F.xxhash64(F.lit(7), "_o"), F.lit(1 << 20)) < part * (1 << 20)))
    w = Window.partitionBy(label_col).orderBy("_o")
    return (thin.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
            .select(*docs.columns))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang",
        clusters: int = CLUSTERS, sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """Learn from the rows with a text and a label."""
    docs = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
            .filter(F.col("text").isNotNull() & F.col("label").isNotNull()))
    n, df = document_frequencies(docs, "text")
    if not n:
        return Model()
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                idx, tf = gram_counts(t.as_py())
                v = np.zeros(DIMS, np.float32)
                if len(idx):
                    v[idx] = tfidf(idx, tf, idf)
                out.append((size_class(tf), v.tobytes()) if len(idx) else (0, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.int32()),
                 pa.array([x[1] for x in out], pa.binary())], names=["label", "size", "v"])

    def centroids(key: tuple, t: pa.Table) -> pa.Table:
        own = sorted(zip(t.column("v").to_pylist(), t.column("size").to_pylist()))
        x = np.stack([np.frombuffer(v, np.float32) for v, _ in own])
        c = _k_means(x, clusters).astype(np.float32)
        return pa.table({"label": [key[0].as_py()], "centroids": pa.array([c.tobytes()], pa.binary()),
                         "sizes": pa.array([[s for _, s in own]], pa.list_(pa.int32())),
                         "cosines": pa.array([(x @ c.T).max(1).tolist()], pa.list_(pa.float64()))})

    vecs = (map_arrow(sample_texts(docs, "text", "label", sample).select("label", "text"), vectors,
                      "label string, size int, v binary").filter("v is not null"))
    rows = sorted(group_arrow(vecs, ["label"], centroids, "label string, centroids binary, sizes array<int>, "
                                                          "cosines array<double>").collect(), key=lambda r: r["label"])
    if not rows:
        return Model()
    model = Model(labels=[r["label"] for r in rows], idf=idf)
    cents = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in rows]
    owner = [k for k, c in enumerate(cents) for _ in c]
    cosines = [x for r in rows for x in zip(r["sizes"], r["cosines"])]
    model.centroids, model.owner = np.concatenate(cents), np.array(owner)
    by_size: dict[int, list[float]] = {}
    for s, v in cosines:
        by_size.setdefault(s, []).append(float(v))
    model.least = {s: FAR * float(np.quantile(v, 0.01)) for s, v in by_size.items() if len(v) >= ENOUGH}
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``rejected`` and ``cosine``."""
    made = ["lang_pred", "score", "rejected", "cosine"]
    docs = docs.drop(*[c for c in made if c != text_col])
    cols = docs.columns
    schema = schema_with(docs, "lang_pred string, score double, rejected boolean, cosine double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column(text_col)]
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in cols]
                + [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)],
                names=schema.names)

    return map_arrow(docs, run, schema)


def held_out(id_col: str, parts: int, part: int):
    """Rows whose crc32 of the id as text leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    return (predict(docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out")), model)
            .drop("text"))

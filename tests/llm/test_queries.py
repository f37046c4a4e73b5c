"""The registered queries: contracts, SQL twins, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_CHECK
from ledgerlake.llm import langid, near_dup, pii, queries
from tools.parity import duck, rows_of

from .helpers import docs, stored

COLUMNS = {
    "op1": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op2": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op3": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op4": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op5": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op6": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op7": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op8": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string "
           "near_edited:double near_next:double",
    "op9": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op10": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op11": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string verified:boolean",
    "op12": "item_id:bigint rank:int doc_id:bigint score:bigint",
    "op13": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, SF_CHECK)
    want = dict(c.split(":") for c in COLUMNS[name.split("_")[0]].split())
    got = dict(df.dtypes)
    assert {c: got.get(c) for c in want} == want
    n = df.count()
    if "doc_id" in want and name not in ("op7_packing", "op12_ranked_search"):
        assert n == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    if name in queries.ORACLE_SQL:
        res = duck(SF_CHECK).execute(queries.ORACLE_SQL[name])
        b, bc = rows_of([d[0] for d in res.description], res.fetchall())
        a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert ac == bc and a == b


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    sf = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    line = "this line of text stands in a great many of the documents"
    extra = docs(spark, ["123 456 !", line + "\nund so weiter", line + "\nand so forth, and so on", line,
                         "mail me at jo.do@mail1.example.com or at 10.20.30.40, please"], first=10 ** 6)
    now = stored(sf.unionByName(extra), tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stored(stage(spark, now, SF_CHECK), tmp_path, name)
        assert now.dtypes == sf.dtypes
        gone = {r.doc_id for r in before.join(now, "doc_id", "left_anti").collect()}
        if name == "language_id":
            assert gone == {10 ** 6}
        elif name == "near_dedup":
            r = near_dup.near_duplicates(before)
            assert gone == {x.doc_id for x in r.where("NOT kept").collect()} and gone
        else:
            assert not gone
        assert now.where(F.col("n_chars") != F.length("text")).count() == 0 or name == "language_id"
    texts = {r.doc_id: r.text for r in now.where(F.col("doc_id") >= 10 ** 6).collect()}
    assert texts[10 ** 6 + 1] == "und so weiter" and texts[10 ** 6 + 3] == line
    assert texts[10 ** 6 + 4] == "mail me at <EMAIL> or at <IP>, please"
    assert pii.find(now).agg(F.sum(F.size("base"))).first()[0] == 0
    assert langid.held_out("doc_id", 4, 2) is not None
    packed = corpus_pipeline.packing(spark, now, SF_CHECK)
    assert packed.select("doc_id").distinct().count() == now.count()


def test_packing_follows_brute_force_order(spark):
    out = corpus_pipeline.run(spark, SF_CHECK)
    r = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert r.where("n <> e OR n > 4096").count() == 0


CLASHES = ["_d", "_t1", "_t2", "_u1", "_u2", "_pos", "_line", "_lines", "_drop", "_k", "_h1", "_h2", "_n", "_keeper", "_kept",
           "_done", "_all", "_row", "_salt", "row", "rest", "kind", "start", "end", "score", "rejected", "kept", "kept_text",
           "redacted", "n_lines", "n_dropped", "component_id", "n_shingles", "lang_pred", "held_out", "Redacted2", "t1", "t2",
           "u", "v", "node", "label", "spans", "all", "base"]


def test_stages_on_awkward_rows_and_clashing_names(spark, tmp_path):
    """Every internal name as a further column; nulls, empty and repeated rows; then an empty table."""
    from .helpers import awkward
    line = "this line of text stands in a great many of the documents"
    more = docs(spark, [f"{line}\nand this is the end of number {k}, mail a{k}@b.org" for k in range(4)] * 2, first=20)
    plain = awkward(spark).unionByName(more)
    wide = plain.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])
    key = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.n_chars), str(r.lang)) for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_in = stored(wide, tmp_path, f"{name}-wide")
        out = stage(spark, docs_in, SF_CHECK)
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(r[c] == f"{c}!" for r in rows[:5] for c in CLASHES)
        assert key(rows) == key(stage(spark, stored(plain, tmp_path, f"{name}-plain"), SF_CHECK).collect())
        empty = stage(spark, stored(wide.limit(0), tmp_path, f"{name}-empty"), SF_CHECK)
        assert empty.columns == wide.columns and empty.count() == 0
    packed = corpus_pipeline.packing(spark, stored(wide, tmp_path, "packing"), SF_CHECK)
    assert packed.select("doc_id").distinct().count() == wide.select("doc_id").distinct().count()

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from ledgerlake.llm import langid

from .helpers import DOCS, awkward


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(langid.learnable(spark.read.parquet(f"{SF_CHECK}/documents.parquet")))


def test_held_out_accuracy(spark):
    got = langid.op9_langid(spark, SF_CHECK)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    r = got.join(docs, "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"),
        F.avg(F.col("rejected").cast("int")).alias("gone")).first()
    assert r.right >= 0.98 and r.gone <= 0.01


def test_texts_without_a_letter_and_foreign_ones(model):
    assert model.labels == sorted(model.labels) and len(model.centroids) > len(model.labels)
    for t in (None, "", " \n", "123 !?. 4"):
        assert model.predict(t)[:3] == ("und", 0.0, True)
    label, score, rejected, cosine = model.predict("Съешь ещё этих мягких французских булок да выпей чаю " * 20)
    assert label in model.labels and rejected and 0 <= score <= 1


def test_awkward_rows(spark, model):
    df = awkward(spark).withColumns({"score": F.lit("old"), "cosine": F.lit(1)})
    out = langid.predict(df, model)
    assert out.count() == df.count()
    assert out.where("lang_pred = 'und'").count() == out.where("text IS NULL OR NOT text rlike '\\\\p{L}'").count()
    assert out.where("score NOT BETWEEN 0 AND 1").count() == 0
    assert langid.predict(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = langid.fit(awkward(spark).withColumn("lang", F.lit(None).cast("string")))
    assert empty.predict("some text")[0] == "und"
    assert langid.fit(awkward(spark).limit(0)).predict("some text")[0] == "und"


def test_texts_of_every_length_can_be_rejected(model):
    far = "Съешь ещё этих мягких французских булок да выпей чаю "
    assert max(model.least) < langid.size_class(langid.gram_counts(far * 4000)[1])
    assert model.predict(far * 4000)[2] and model.predict("Съешь ещё")[2]


def test_all_labels_and_copied_texts_are_learned(spark):
    word = lambda k: "".join(chr(97 + (k // 26 ** j) % 26) for j in range(3)) * 3
    rows = [(k, f"{word(7 * k)} {word(7 * k + 1)}", f"l{k:03}", "s", 1) for k in range(260)]
    rows += [(1000 + k, "qqz zqj jqz xqz", "rare", "s", 1) for k in range(9000)]  # one text
    docs = spark.createDataFrame(rows, DOCS)
    assert len(langid.fit(docs, clusters=1).labels) == 261
    picked = langid.sample_texts(docs, "text", "lang", 8).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in picked} == {**{f"l{k:03}": 1 for k in range(260)}, "rare": 8}

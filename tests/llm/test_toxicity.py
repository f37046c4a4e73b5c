import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from ledgerlake.llm import toxicity

from .helpers import awkward, docs


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF_CHECK}/documents.parquet"),
                        spark.read.parquet(f"{SF_CHECK}/labels.parquet"))


def test_disguised_words_are_restored(model):
    for word, plain in [("1d10t", "idiot"), ("stuuupid", "stupid"), ("tr@sh", "trash"), ("m*ron", "moron"),
                        ("cl-own", "clown"), ("s.c.u.m", "scum"), ("scummm", "scum"), ("l0ser!", "loser")]:
        assert model.restore(word) == plain
        assert model.score(f"The of {word} and in.") >= toxicity.TOXIC
    assert model.score("and the s t u p i d of") >= toxicity.TOXIC
    assert model.restore("plain") == "plain"


def test_clean_texts_stay_clean(model):
    for text in [None, "", "The of and in, erthe.", "a - b - c 1.2.3 4,5", "%$#*& *** ### !!!", "2024 100% 3.5"]:
        assert model.score(text) < toxicity.TOXIC


def test_held_out(spark):
    got = toxicity.op5_toxicity(spark, SF_CHECK)
    r = (got.join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id").where("held_out")
         .groupBy("toxic").agg(F.avg("predicted").alias("p")).collect())
    share = {x.toxic: x.p for x in r}
    assert share[0] <= 0.02 and share[1] >= 0.75  # 27 toxic texts to learn from


def test_copies_do_not_make_ordinary_words_toxic(spark):
    texts = ["ordinary words of one copied text scum"] * 30 + [f"word{k} scum other{k}" for k in range(9)]
    texts += [f"clean{k} texts with ordinary ones word{k}" for k in range(60)]
    labels = spark.createDataFrame([(k, 1, int(k < 39)) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs(spark, texts), labels)
    assert m.score("so much scum") >= toxicity.TOXIC
    assert m.score("ordinary words of one copied text") < toxicity.TOXIC


def test_awkward_rows(spark, model):
    df = awkward(spark).withColumns({"score": F.lit("old"), "predicted": F.lit("x")})
    out = toxicity.predict(df, model)
    assert out.count() == df.count() and out.where("score NOT BETWEEN 0 AND 1").count() == 0
    assert toxicity.predict(df.limit(0), model).count() == 0
    none = toxicity.fit(df, spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert none.score("scum") == 0.0


def test_every_disguised_word_is_decoded(model):
    for word, plain in [("st" + "u" * 60 + "pid", "stupid"), ("###idiot", "idiot"), ("***idiot", "idiot"),
                        ("idiot###", "idiot"), ("worthless***", "worthless"), ("####trash####", "trash"),
                        ("stuupid", "stupid"), ("1d11ot", "idiot")]:
        assert plain in model.readings(word), word
        assert model.score(f"The of {word} and in.") >= toxicity.TOXIC, word
    for text in ["and the $ t u p i d of", "and the s t u p ! d of"]:
        assert model.score(text) >= toxicity.TOXIC
    for word in ["5h17", "f***"]:
        assert model.restore(word).isalpha()
    assert model.restore("#" * 3000 + "scum" + "x" * 50_000).startswith("scum")


def test_rare_toxic_words_are_learned_beside_many_ordinary_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 20, raising=False)  # a cap by frequency, if there is one
    ordinary = [f"{a}{b}ordin" for a in "abcdefgh" for b in "klmnop"]
    line = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x {w}" for w in ordinary)
    texts = [line(k) + (f" q{chr(97 + k)}y scum" if k < 4 else "") for k in range(40)] + [line(k) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k < 40)) for k in range(240)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs(spark, texts), labels)
    assert m.score("so much scum") >= toxicity.TOXIC
    assert m.score(" ".join(ordinary)) < toxicity.TOXIC


def test_decoding_is_the_best_path():
    """Against all paths of short disguised words, the likeliest by the same costs."""
    import itertools
    import random

    import numpy as np

    rng = random.Random(4)
    model = toxicity.Model(lm=np.log(np.random.default_rng(2).random((toxicity.SIZE,) * 3)), letters="test")
    code = toxicity._codes()

    def options(word, i):
        c, again = word[i], i and word[i - 1] == word[i]
        if c.isalpha():
            return [(c, 0.0)] + ([("", toxicity.REPEAT)] if again else [])
        if c in toxicity.ANY:
            return [(x, toxicity.WILD) for x in toxicity.LETTERS] + [("", toxicity.DROP)]
        if c in toxicity.LEET:
            more = [("", toxicity.DROP)] if not c.isdigit() else [("", toxicity.REPEAT)] if again else []
            return [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET[c]] + more
        return [("", toxicity.DROP)]

    def cost(text, paid):
        a, b = 0, 0
        for x in [*text, " "]:
            k = int(code[ord(x)]) if x != " " else 0
            paid += model.lm[a, b, k]
            a, b = b, k
        return paid

    for _ in range(300):
        word = "".join(rng.choice("abeell013@$!*-é") for _ in range(rng.randint(1, 6)))
        if sum(c in toxicity.ANY for c in word) > 2:
            continue
        best = max(cost("".join(x for x, _ in p), sum(q for _, q in p))
                   for p in itertools.product(*[options(word, i) for i in range(len(word))]))
        got = model.decode(word)
        paths = [sum(q for _, q in p) for p in itertools.product(*[options(word, i) for i in range(len(word))])
                 if "".join(x for x, _ in p) == got]
        assert abs(cost(got, max(paths)) - best) < 1e-9

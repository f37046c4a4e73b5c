import hashlib
import random
import re

from pyspark.sql import functions as F

from conftest import SF_CHECK
from ledgerlake.llm import pii

from .helpers import awkward, docs, stored


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m.group())]


def check(found):
    for r in found:
        assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base] == base(r.text), r.text[:200]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.all))


def with_text(df):
    t1, t2 = pii.hash128(F.coalesce("text", F.lit("")))
    texts = df.select(F.coalesce("text", F.lit("")).alias("text"), t1.alias("t1"), t2.alias("t2")).distinct()
    return pii.find(df).join(texts, ["t1", "t2"]).collect()


def test_base_rules_on_random_texts(spark, tmp_path):
    rng = random.Random(3)
    chars = "ab.@1234567890 -+()%_é\n𝒳255"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["a.b@c.d_e@f.g@h.i@j.k.l..", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.1.1." + "0" * 30 + "1",
              "1" * 20_000, "a" * 40_000 + "@b.c", "4111 1111-1111 1111 4111-1111-1111-1111", "1-" * 15_000, "1." * 9000]
    df = stored(docs(spark, texts), tmp_path)
    got = with_text(df)
    assert len(got) == len(texts)
    check(got)


def test_awkward_rows(spark, tmp_path):
    df = stored(awkward(spark).withColumns({"all": F.lit(1), "redacted": F.lit("old")}), tmp_path)
    found = pii.find(df)
    assert found.count() == df.count()
    out = pii.redact(df)
    assert out.count() == df.count() and out.columns == [*[c for c in df.columns if c != "redacted"], "redacted"]
    assert {r.redacted for r in out.where("doc_id = 7").collect()} == {"<EMAIL> <IP>"}
    assert pii.find(df.limit(0)).count() == 0


def test_trees_add_what_the_rules_miss(spark, tmp_path):
    sf = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    both = "call +1 (269) 555-3296 4524132264652876 now"
    clean = "version 4.0.12 of 2024-01-05, part 12345, AKIA123456789, see 10 of 20"
    df = stored(sf.unionByName(docs(spark, [both, clean], first=10 ** 9)), tmp_path)
    got = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.written("all").alias("s")).where(
        F.col("doc_id") >= 10 ** 9).collect()}
    assert got[10 ** 9].s.split(",") == [f"card:{both.index('4524')}:{both.index(' now')}",
                                         f"phone:{both.index('+1')}:{both.index(' 4524')}"]
    assert got[10 ** 9 + 1].s == ""
    red = pii.redact(df).where(F.col("doc_id") == 10 ** 9).first().redacted
    assert red == "call <PHONE> <CARD> now"


def test_query_digest(spark):
    row = pii.op3_pii(spark, SF_CHECK).where("n_email > 0").first()
    text = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest()


def test_every_candidate_takes_part_in_the_fit(spark, monkeypatch):
    """30,000 texts with a valid and a dropped run each: all count, and each valid span's spoilt copy."""
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string(
        "from %d.7.7.7 to %d.999.7.7", F.pmod("id", F.lit(200)), F.pmod("id", F.lit(200))).alias("text"))
    kept, store = {}, pii.stored
    monkeypatch.setattr(pii, "stored", lambda rows, name: kept.setdefault(name, store(rows, name)))
    trees, least = pii.fit(pii.candidates(df))
    rows = kept["spans"].groupBy("label").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {r.label: r.n for r in rows} == {1.0: n, 0.0: 2 * n}
    assert all(r.rows < 100 for r in rows)
    assert 1 in least

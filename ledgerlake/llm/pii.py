"""Personal data: candidate spans scored by gradient-boosted trees.

Generators of high recall propose spans that may overlap.  Four of them are
the base rules (email, ip, card, phone), whose valid spans always stand.  The
others propose what the base rules miss, such as a phone number and a card
number that stand side by side and read as one run of digits.  Boosted
trees (Spark ML) score a candidate by its format and the characters around
it; per kind, the lowest score that was precise enough on held-out
candidates is the threshold.  Accepted candidates that overlap no base span
are added, the leftmost first.

The trees learn from the base rules: their valid spans are positive; runs the
rules matched but dropped, and valid spans with one property spoilt, are
negative.  Every such candidate counts: three quarters fit the trees, a quarter
sets the thresholds.  Equal feature vectors are one row with a weight, so the
fit grows with the distinct vectors.

Everything is DataFrame operations.  Patterns are written so that matching
stays linear (possessive, no start inside a run).  A text is read once; only
candidates, with their lengths and the gaps between them, are shuffled, by
row, and running sums of these give the positions in code points.

Defined results: null text is empty; rows without candidates have zero
counts and empty lists; every row, also a repeated one, is returned; ids may
be null; other columns are left out of the result; with too few examples of
both kinds nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import from_row, hash128, in_row, out_of_row, read, stored

MIN_EXAMPLES = 20     # of each label, to fit at all
ROUNDS, LEVELS = 12, 3
PRECISE = 0.99        # on held-out candidates of a kind
STRICT = 0.75         # no threshold is lower
CONTEXT = 12

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
# The base rules.  A match starts at the start of a run of its characters or
# where the last match ended: the same matches, without trying every start.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = {
    "email": [r"(?<![^\s<(\[,;:])[^\s@<>()\[\],;:]++@[^\s@<>()\[\],;:]*[^\s@<>()\[\],;:.!?]"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"],
    "card": [r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"],
    "phone": [r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
              r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"],
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
FEATURES = ["kind", "length", "digits", "letters", "dots", "dashes", "spaces", "plus", "parens", "odd",
            "luhn", "octets", "left", "right"]


def _matches(text: Column, pattern: str, kind: int, generator: int) -> Column:
    """A pattern's matches: number, length, gap before, and characters around."""
    gaps = F.split(text, pattern, -1)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(generator).alias("generator"), i.alias("i"), m.alias("match"),
        F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("length"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))


def _luhn(digits: Column) -> Column:
    """1 if 13 to 19 digits pass the check."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 0, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48)
    ).otherwise(F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48))
    return F.when(n.between(13, 19), (total % 10 == 0).cast("int")).otherwise(0)


def _char_class(c: Column) -> Column:
    return (F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2)
            .when(c.rlike(r"^\p{L}$"), 3).when(c.rlike(r"^[.,;:!?)\]>\"']$"), 4).otherwise(5))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate (one with a null kind for a text without any),
    with ``row``, ``doc_id``, ``t1``, ``t2`` (hash of the text) and features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hash128(text)
    found = [_matches(F.col("_t"), BASE[k], n, n) for n, k in enumerate(KINDS)]
    extra = [(n, p) for n, k in enumerate(KINDS) for p in MORE[k]]
    found += [_matches(F.col("_t"), p, n, len(KINDS) + g) for g, (n, p) in enumerate(extra)]
    spans = F.when(F.col("_t").rlike("[0-9@]"), F.concat(*found))
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        t1.alias("t1"), t2.alias("t2"), text.alias("_t"))
            .select("row", "doc_id", "t1", "t2", F.explode_outer(spans).alias("s"))
            .select("row", "doc_id", "t1", "t2", "s.*"))
    digits = F.regexp_replace("match", "[^0-9]", "")
    count = lambda chars: F.length("match") - F.length(F.regexp_replace("match", chars, ""))
    return rows.withColumns({
        "digits": F.length(digits), "letters": count(r"\p{L}"), "dots": count(r"\."), "dashes": count("-"),
        "spaces": count(" "), "plus": count(r"\+"), "parens": count("[()]"),
        "odd": count(r"[\p{L}0-9@._%+() -]") * -1 + F.length("match"), "luhn": _luhn(digits),
        "octets": F.col("match").rlike(OCTETS).cast("int"),
        "left": _char_class(F.right("before", F.lit(1))), "right": _char_class(F.left("after", F.lit(1))),
    }).drop("match", "before", "after")


def _valid() -> Column:
    """Whether a base rule's match holds."""
    return (F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.col("octets") == 1)
            .when(F.col("kind") == 2, F.col("luhn") == 1)
            .otherwise(F.col("digits").between(9, 15)))


def fit(found: DataFrame):
    """The trees and the threshold of each kind, or None."""
    base = (found.filter(F.col("generator") < len(KINDS)).filter(~((F.col("kind") == 2) & (F.col("digits") < 8)))
            .select("row", "kind", "i", *FEATURES[1:], _valid().cast("double").alias("label")))
    order = F.xxhash64("row", "kind", "i")
    good = F.col("label") == 1
    # One pass over the candidates: a valid span gives itself and its spoilt copy.
    base = base.withColumns({
        "test": F.pmod(F.xxhash64(F.lit(3), "row", "kind", "i"), F.lit(4)) == 0,
        "spoilt": F.explode(F.when(good, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))})
    spoil = lambda k, c, v: F.when(F.col("spoilt") & (F.col("kind") == k), v).otherwise(F.col(c))
    base = base.withColumns({
        "label": F.when(F.col("spoilt"), 0.0).otherwise(F.col("label")),
        "dots": spoil(0, "dots", F.lit(0)), "octets": spoil(1, "octets", F.lit(0)), "luhn": spoil(2, "luhn", F.lit(0)),
        "digits": spoil(3, "digits", F.pmod(order, F.lit(8)).cast("int"))})
    alike = ["label", "test", *FEATURES]
    rows = base.groupBy(*alike).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.sortWithinPartitions(*alike))
                  .select("kind", "label", "features", "test", "weight"), "spans")
    n = {r["label"]: r["n"] for r in rows.filter("NOT test").groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if min(n.get(0.0, 0), n.get(1.0, 0)) < MIN_EXAMPLES:
        return None
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=LEVELS, seed=7, weightCol="weight").fit(rows.filter("NOT test"))
    score = vector_to_array("probability")[1]
    steps = (trees.transform(rows.filter("test")).groupBy("kind", F.floor(score * 100).alias("step"))
             .agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect())  # 101 steps a kind at most
    least = {}
    for kind in range(len(KINDS)):
        a = b = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            a, b = a + r["good"], b + r["n"]
            if a / b >= PRECISE:
                least[kind] = max(STRICT, r["step"] / 100)
    return trees, least


def accept(found: DataFrame) -> DataFrame:
    """The base spans and the added ones: row, kind, start, end, is_base (code points, end
    exclusive); a row with a null kind stays for each text without candidates."""
    w = Window.partitionBy("row", "generator").orderBy("i")
    rows = found.withColumn("is_base", (F.col("generator") < len(KINDS)) & _valid())
    model = fit(found)
    proposed = (F.col("generator") >= len(KINDS)) & F.col("kind").isNotNull()
    if model is None:
        rows = rows.withColumn("score", F.when(F.col("is_base"), 1.0))
    else:
        trees, least = model
        enough = F.try_element_at(F.create_map(*[x for k in KINDS for x in (
            F.lit(KINDS.index(k)), F.lit(least.get(KINDS.index(k), 2.0)))]), F.col("kind"))
        scored = trees.transform(
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(
                rows.fillna(0, FEATURES[1:]).withColumn("_kind", F.col("kind")).fillna(0, ["kind"])))
        rows = scored.withColumn("kind", F.col("_kind")).withColumn(
            "score", F.when(F.col("is_base"), 1.0).when(
                proposed & (vector_to_array("probability")[1] >= enough), vector_to_array("probability")[1]))
    # Candidates are scored where they lie; only what the positions need is shuffled.
    rows = (rows.select("row", "doc_id", "t1", "t2", "kind", "generator", "i", "gap", "length", "is_base", "score").repartition("row")
            .withColumn("end", F.sum(F.col("gap") + F.col("length")).over(w))
            .withColumn("start", F.col("end") - F.col("length"))
            .select("row", "doc_id", "t1", "t2", "kind", "start", "end", "is_base", "score"))
    up = Window.partitionBy("row").orderBy("start", F.desc_nulls_last("is_base"))
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc_nulls_last("is_base"))
    before = F.max(F.when(F.col("is_base"), F.col("end"))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("is_base"), F.col("start"))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    clash = (F.coalesce(F.col("_before") > F.col("start"), F.lit(False))
             | F.coalesce(F.col("_after") < F.col("end"), F.lit(False)))
    return (rows.withColumns({"_before": before, "_after": after})
            .withColumn("span", F.when(F.col("is_base") | (F.col("score").isNotNull() & ~clash),
                                       F.struct("start", F.col("score").alias("score"), "end", "kind", "is_base"))))


def spans(found: DataFrame) -> DataFrame:
    """Per row: ``base`` and ``all`` spans, as sorted arrays of (kind, start, end)."""
    rows = (accept(found).groupBy("row")
            .agg(F.first("doc_id").alias("doc_id"), F.first("t1").alias("t1"), F.first("t2").alias("t2"),
                 F.collect_list("span").alias("spans")))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["is_base"]), plain)
    # Added spans from left to right; of those that start together the surest first.
    more = F.array_sort(F.transform(F.filter("spans", lambda s: ~s["is_base"]), lambda s: F.struct(
        s["start"].alias("start"), (-s["score"]).alias("doubt"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.slice(base, 1, 0).alias("kept"))
    taken = F.aggregate(more, none, lambda a, s: F.when(
        s["start"] >= a["end"], F.struct(s["end"].alias("end"), F.concat(a["kept"], F.array(plain(s))).alias("kept")))
        .otherwise(a), lambda a: a["kept"])
    return rows.select("row", "doc_id", "t1", "t2", F.array_sort(base).alias("base"),
                       F.array_sort(F.concat(base, taken)).alias("all"))


def written(spans_col: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return spans(stored(candidates(docs, id_col, text_col), "candidates"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``redacted``: the text with each span replaced by its kind, as ``<EMAIL>``."""
    found = (find(docs, id_col, text_col).filter(F.size("all") > 0)
             .select(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("all").alias("_all"))
             .dropDuplicates(["_d", "_t1", "_t2"]))
    text = F.coalesce(from_row(text_col), F.lit(""))
    t1, t2 = hash128(text)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform("_all", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(by_start, start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                                               F.get(names, s["kind"]))).otherwise(a["out"]).alias("out")))
    joined = (in_row(docs).withColumns({"_u1": t1, "_u2": t2})
              .join(found, from_row(id_col).eqNullSafe(F.col("_d")) & (F.col("_u1") == F.col("_t1"))
                    & (F.col("_u2") == F.col("_t2")), "left")
              .withColumn("_done", F.when(F.col("_all").isNotNull(), done)))
    rest = F.substring(text, (F.col("_done.at") + 1).cast("int"), F.length(text))
    redacted = F.when(F.col("_done").isNull(), from_row(text_col)).otherwise(F.concat("_done.out", rest))
    return joined.select(*out_of_row(docs.columns, {"redacted": redacted}))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return (find(read(spark, sf_dir, "documents"))
            .select("doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"),
                    written("all").alias("spans")))

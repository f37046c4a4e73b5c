import collections
import hashlib

from pyspark.sql import functions as F

from ledgerlake.llm.line_dedup import dedup_lines

from .helpers import awkward, docs, stored

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WS).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    last = lambda s: max((x for x in s if x is not None), default=None)
    drop = {k: last(s) for k, s in holders.items() if len(s) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in dedup_lines(df).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)


def test_awkward_rows_and_clashing_columns(spark, tmp_path):
    shared = "A Line that is Shared by many"
    more = docs(spark, [f"own {k}\n {shared.upper()}\t\n{shared}\n\nend" for k in range(5)], first=100)
    df = stored(awkward(spark).unionByName(more).withColumns({
        "n_lines": F.lit("old"), "kept_text": F.lit(1), "n_dropped": F.lit(None).cast("int")}), tmp_path)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(df) == brute(rows)
    assert dedup_lines(df).count() == len(rows)


def test_hot_line_and_threshold(spark, tmp_path):
    texts = ["the one line that all texts hold\n" + f"a line of exactly two {k // 2} texts" for k in range(300)]
    texts += ["only twelve.", "a line of nineteen.", "all dropped line, all of it"] * 3
    df = stored(docs(spark, texts), tmp_path)
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(spark, tmp_path):
    assert run(stored(docs(spark, ["x"]).limit(0), tmp_path)) == []

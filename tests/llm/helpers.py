"""Small tables with the awkward cases every operator must handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet " * 4000


def docs(spark, texts, first=0):
    """A documents table of the given texts."""
    rows = [(first + k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \t\n ", "en", "s", 5),
            (4, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)),
            (6, "one", "en", None, 3), (6, "one", "en", None, 3), (7, "a.b@c.de 1.2.3.4", None, "s", 16),
            (None, "no id here at all, none", "en", "s", 23), (None, None, None, None, None),
            (8, "same id", "en", "s", 7), (8, "other text, same id", "en", "s", 19),
            (9, "x" * 50_000, "en", "s", 50_000), (10, "é日𝒳\x00\x1c ", "fr", "s", 6)]
    return spark.createDataFrame(rows, DOCS)


def stored(df, tmp_path, name="docs"):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

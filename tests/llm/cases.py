"""Rows that every operator must bear."""

LONG = "the quick brown fox jumps over the lazy dog and naps " * 3000
ROWS = [
    (1, "Alpha beta gamma delta.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "alpha BETA gamma delta.", "en", None, 3),
    (5, "   \n\t ", "de", "b", 1),
    (6, LONG, "en", "b", 99),
    (7, LONG, "en", "b", 99),
    (8, "Ünïcödé Straße ΑΒΓ 😀 日本", "de", "c", 5),
    (8, "Ünïcödé Straße ΑΒΓ 😀 日本", "de", "c", 5),
    (9, "x", None, "c", 1),
    (None, "orphan text without an id", "en", "d", 2),
    (10, "one line\nsecond line here\nthird", "en", "a", 4),
    (11, "one line\nsecond line here\nfourth", "en", "a", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS, clash=True):
    """The rows as a table, with more columns whose names operators use themselves."""
    frame = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("id", "h", "n", "size", "ids", "keep_id", "score", "fp", "copies", "d1", "gone", "words", "label", "media", "found", "all", "rank", "_gone", "_sha", "_u", "_size", "_skey", "th", "node", "root", "n_tokens", "cut", "prefix", "hit", "lines", "idx"):
            frame = frame.selectExpr("*", f"'extra' as {name}")
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

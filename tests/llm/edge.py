"""Rows that no operator may trip over: nulls, empty and long texts, ties, repeated rows, clashing columns."""

CLASHES = ["size", "content", "anchor", "tail", "fingerprint", "words", "file", "row", "fate", "w", "ids", "part", "n", "f", "best", "digest"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))
TEXTS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n\r\x0b\x0c ", "en", "a"), (None, PASSAGE + " and more", "en", None), (None, PASSAGE + " and more", "en", None),
    (6, PASSAGE, None, "b"), (7, "before it " + PASSAGE, "de", "b"), (8, PASSAGE + " after it\n" + PASSAGE, "de", "a"), (8, PASSAGE, "de", "a"),
    (10, LONG, "en", "c"), (11, LONG + " end", "en", "c"), (12, "a", "en", "c"), (13, "123 456 !!", "en", "a"), (14, "Ünïcödé text ﬁ 😀 ▁mark <|endoftext|> <s>", "fr", "é"),
    (15, "a " * 300, "en", "a"), (16, "same line\nsame line\n\nother\nsame line", "en", "B"), (17, "x" * 5000, "en", "a"), (18, "one two", "en", "a"), (19, "One TWO", "en", "a"),
]
ROWS = [(i, t, lang, source, len(t or ""), *["clash"] * len(CLASHES)) for i, t, lang, source in TEXTS]


def frame(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

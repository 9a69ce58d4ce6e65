"""Documents that any operator must take: nulls, empty and long texts, repeats, clashing extra columns."""

LONG = "word " * 30_000 + "x" * 60_000 + " <s> +1 (212) 555-0100 a@b.co 10.0.0.1"


def documents(spark, *extra: str):
    """Rows whose extra columns carry the names an operator would like to use itself."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, "no id but words enough to be a text of its own", None, None, 5),
        (4, " \t\n\x0b ", "de", "b", 4),
        (5, "123 456 !!! ...", "de", "b", 9),
        (6, LONG, "en", "c", len(LONG)),
        (7, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
        (8, "Ünïcödé 日本語 ß 😀 text with odd\x00 characters", "fr", "c", 30),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in extra:
        from pyspark.sql import functions as F

        frame = frame.withColumn(name, F.lit("mine"))
    return frame


def none(spark):
    return documents(spark).limit(0)

"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, further columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", "   ", "one", "Same text here.", "Same text here.", "É x\ty\nz", "word " * 5000, "a b c d e f g h i j k", "<|endoftext|> x", "\n\n"]


def clashing(df):
    """df with columns whose names operators are likely to use themselves."""
    from pyspark.sql import functions as F

    for name in ("size", "words", "token", "slot", "n", "component_id", "score", "h", "rank", "copies", "key"):
        df = df.withColumn(name, F.lit("x"))
    return df

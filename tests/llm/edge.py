"""A table of documents with every edge case, for all operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
PROSE = "The river bends twice before the mill. Its water turns the old wheel slowly, and the miller counts every sack."
LONG = " ".join(f"word{i % 977} and number {i} follow here." for i in range(30_000))
TEXTS = [
    None, "", " \t\n ", "one", PROSE, PROSE.upper(), PROSE + " More grain comes with the morning carts from the hills.",
    "a  b\n\n c\t", LONG, LONG, "日本語のテキスト 😀 é", "x<|endoftext|>y <|im_end|> [INST] \\ \\\\", "\n".join([PROSE] * 4),
]


def documents(spark, extra=False):
    """One row per text, a null id, a repeated row, null metadata; ``extra``: further columns whose names clash with inner ones."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["s0", "s0", None, "s1"][i % 4], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, PROSE, "en", "s0", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("k", "t", "n", "fp", "kept", "words", "n_words", "id", "__row", "__text", "part", "group", "score", "rank", "KEPT2"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

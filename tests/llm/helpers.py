"""Small tables with the cases every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("root", T.StringType()), T.StructField("t", T.StringType())])


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]); further columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, *["en", "s"][len(r) - 2 :], 7, "x", "y") for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "a row without an id"), (5, "tie tie tie"), (5, "tie tie tie"), (6, "!!! ??? 123"), (7, "x" * 50_000), (8, "wörd " * 30_000), (9, " é 中文 text")]

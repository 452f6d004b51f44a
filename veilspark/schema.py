"""Column types shared by every operator.

Offsets are zero-based code-point positions, which is what Spark's ``length``,
``substring`` and ``locate`` count.
"""

from pyspark.sql import types as T

DETECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

CHUNK = T.StructType([
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("offset", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

TOKEN = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

TAGGED_CHUNK = T.StructType([
    T.StructField("tokens", T.ArrayType(TOKEN)),
    T.StructField("error", T.StringType()),
])

WORD = T.StructType([
    T.StructField("piece", T.StringType()),
    T.StructField("word", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("sub_end", T.IntegerType()),
])

ENTITY = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("word", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

ML_DETECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

MAPPING = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("mask", T.StringType()),
    T.StructField("value", T.StringType()),
])

SETTINGS = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("maskingMode", T.StringType()),
    T.StructField("useML", T.BooleanType()),
])

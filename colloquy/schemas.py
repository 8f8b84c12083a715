"""Explicit schemas of the entities the library reads and writes."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
#: Both key layouts of a message list at once; absent keys read as null.
ANY_MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("response", T.StringType())]))
GENERATED = T.StructType([T.StructField("text", T.StringType()), T.StructField("prompt_tokens", T.IntegerType()), T.StructField("generated_tokens", T.IntegerType()), T.StructField("elapsed_sec", T.DoubleType())])
CRITERIA = ("fluency", "coherence", "naturalness", "empathy", "appropriateness", "engagement")

"""Explicit schemas; nothing is ever inferred from files."""

from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())

POST = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("community", T.StringType()),
    T.StructField("created_utc", T.LongType()),
])

COMMENT = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("community", T.StringType()),
])

ARTICLE = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("cleaned_content", T.StringType()),
])

SAMPLE_SPEC = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("num_actions_total", T.LongType()),
    T.StructField("start_index", T.LongType()),
    T.StructField("episode_length", T.LongType()),
])

# One row per author, or per segment of a very long history (see operators/history.py).
HISTORY = T.StructType([
    T.StructField("author_id", T.LongType()),
    T.StructField("segment", T.LongType()),
    T.StructField("syms", T.ArrayType(_INTS)),
    T.StructField("hour", _INTS),
    T.StructField("minute", _INTS),
    T.StructField("day", _INTS),
    T.StructField("action_type", _INTS),
])

EPISODE_INDEX = T.StructType([
    T.StructField("author_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
])

EMBEDDING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("label", T.LongType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

# The features a record may carry: name -> whether it is a sequence over the posts of a history.
FEATURES = {
    "author_id": False,
    "num_posts": False,
    "syms": True,
    "lens": True,
    "action_type": True,
    "hour": True,
    "minute": True,
    "day": True,
}

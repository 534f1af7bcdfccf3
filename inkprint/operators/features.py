"""Untrained stand-in for the post encoder, and pooling of posts to episodes.

Per post: presence of word n-grams of width 2-4 in hashed buckets, one-hot community, one-hot hour. Pooling keeps,
per feature, the maximum and the mean over the posts of the episode. All of it stays sparse and long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.functions.arrays import bind
from inkprint.functions.vectors import l2_normalize

NGRAM_BUCKETS = 64
NGRAM_WIDTHS = (2, 3, 4)
HOURS = 24


def ngram_buckets(tokens: Column, buckets: int = NGRAM_BUCKETS, widths: tuple[int, ...] = NGRAM_WIDTHS) -> Column:
    """Distinct hashed buckets of all n-grams: the best response over positions of a presence filter."""
    # Width n is width n-1 extended by one word: each level is one linear pass over the words.
    grams, found = tokens, []
    for width in range(2, max(widths) + 1):
        count = F.greatest(F.size(tokens) - (width - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), count), F.slice(tokens, F.lit(width), count),
                           lambda head, last: F.concat(head, F.lit(" "), last))
        if width in widths:
            found.append(F.transform(grams, lambda g: F.substring(F.md5(g), 1, 8)))
    # With a power of two of buckets the last digits decide: few distinct ones are left before any is read as a number.
    digits = (buckets.bit_length() + 2) // 4 if buckets.bit_count() == 1 else 8
    ends = [F.transform(f, lambda h: F.substring(h, 9 - max(1, digits), 8)) for f in found]
    return F.array_distinct(F.transform(F.array_distinct(F.concat(*ends)), lambda h: (
        F.conv(h, 16, 10).cast("bigint") % F.lit(buckets)).cast("int")))


def post_features(grams: Column, action: Column | None, hour: Column, n_actions: int,
                  buckets: int = NGRAM_BUCKETS) -> Column:
    """Indices of the features that are 1: n-gram buckets, then community, then hour. Without a community the
    text-and-time variant results."""
    base = buckets + (n_actions if action is not None else 0)
    clock = F.when((hour >= 0) & (hour < HOURS), F.array((hour + base).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    parts = [grams]
    if action is not None:
        parts.append(F.array((action + buckets).cast("int")))
    return F.concat(*parts, clock)


def pool_posts(members: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """(keys, feature, max_value, mean_value): pooled over the real posts of an episode, absent features omitted.

    Every post also carries the mark -1, whose count is the number of posts. The compact arrays are shuffled once by
    episode (bounded in size), and counting and dividing follow without another shuffle.
    """
    placed = members.select(*keys, F.concat(F.array(F.lit(-1)), F.col(features)).alias("_f")).repartition(*keys)
    hits = placed.select(*keys, F.explode("_f").alias("feature")).groupBy(*keys, "feature").agg(
        F.count("*").alias("hits"))
    n_posts = F.max(F.when(F.col("feature") == -1, F.col("hits"))).over(Window.partitionBy(*keys))
    return hits.withColumn("n_posts", n_posts).where(F.col("feature") >= 0).select(
        *keys, "feature", F.lit(1.0).alias("max_value"), (F.col("hits") / F.col("n_posts")).alias("mean_value"))


def pool_vectors(members: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Per-dimension maximum and mean of dense vectors, maximum first."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dense = members.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    stats = dense.groupBy(*keys).agg(Summarizer.metrics("max", "mean").summary(F.col("_v")).alias("s"))
    return stats.select(*keys, F.concat(vector_to_array("s.max"), vector_to_array("s.mean")).alias("vec"))


def episode_vectors(pooled: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Dense unit vectors of length 2 * width: maxima, then means. A row is bounded by the feature count."""
    entries = F.map_from_entries(F.collect_list(F.struct("feature", "mean_value")))
    rows = pooled.groupBy(*keys).agg(entries.alias("m"))
    means = rows.withColumn("mean", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))))
    peaks = F.transform("mean", lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return means.select(*keys, bind(F.concat(peaks, F.col("mean")), l2_normalize).alias("vec"))

"""Community vocabulary and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from inkprint.functions import sampling, text
from inkprint.operators.history import UNKNOWN_ACTION
from inkprint.operators.prefix import take_in_order
from inkprint.session import settle


def kept_posts(posts: DataFrame, body: str = "body") -> DataFrame:
    return posts.where(text.keep_post(F.col(body)))


def action_counts(posts: DataFrame, column: str = "community") -> DataFrame:
    """Frequency of every community, trailing white space removed."""
    return posts.groupBy(text.strip_trailing(F.col(column)).alias("action")).agg(F.count("*").alias("n"))


def top_actions(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n"), "action").limit(k)


def action_vocab(counts: DataFrame, size: int) -> DataFrame:
    """The size-1 most frequent communities get ids 0.., the unknown entry gets the last id. Ties go by name.

    Fails when there are too few communities or one carries the reserved name."""
    counts = settle(counts)
    best = counts.orderBy(F.desc("n"), "action").limit(size - 1)
    # At most size-1 rows reach this window.
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "action")
    numbered = best.select("action", (F.row_number().over(ordered) - 1).cast("bigint").alias("action_id"), "n")
    if counts.where(F.col("action") == UNKNOWN_ACTION).limit(1).count():
        raise ValueError(f"{UNKNOWN_ACTION} is reserved and may not be a community name")
    found = best.count()
    if found != size - 1:
        raise ValueError(f"asked for {size} entries but only {found + 1} exist")
    unknown = numbered.sparkSession.range(1).select(
        F.lit(UNKNOWN_ACTION).alias("action"), F.lit(size - 1).cast("bigint").alias("action_id"),
        F.lit(None).cast("bigint").alias("n"))
    return numbered.unionByName(unknown)


def corpus_stats(posts: DataFrame, body: str = "body") -> DataFrame:
    return posts.agg(F.count("*").alias("n_total"), F.count_if(text.keep_post(F.col(body))).alias("n_kept"))


def corpus_lines(posts: DataFrame, body: str = "body") -> DataFrame:
    """One cleaned line per kept post."""
    return kept_posts(posts, body).withColumn(body, text.clean_newlines(F.col(body)))


def short_posts(posts: DataFrame, key: str, count: int = 5, below: int = 15, body: str = "body") -> DataFrame:
    """A preview: the first `count` + 1 posts with fewer than `below` words."""
    return posts.where(text.word_count(F.col(body)) < below).orderBy(key).limit(count + 1)


def sample_sentences(lines: DataFrame, key: str, count: int, seed: str = "sentences") -> DataFrame:
    """A repeatable random sample of exactly min(count, all) lines."""
    return take_in_order(lines, sampling.hash32(seed, F.col(key)), [key], count)

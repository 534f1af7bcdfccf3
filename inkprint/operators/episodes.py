"""Episodes: reproducible sub-sequences of histories, and labelled pairs of them.

An episode is chosen from (author, number of posts) alone. Its wanted positions then meet the posts on
(author_id, pos), a key that is unique among posts, so no author is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkprint.functions import sampling
from inkprint.functions.arrays import gather, slice_at
from inkprint.operators.history import SEGMENT_POSTS
from inkprint.operators.prefix import number_rows, take_first
from inkprint.session import settle

EPISODE_POSTS = 16


def author_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("author_id").agg(F.count("*").alias("n"))


def draw_samples(counts: DataFrame, seed: str, samples: int = 1, shortest: int = EPISODE_POSTS,
                 longest: int = EPISODE_POSTS) -> DataFrame:
    """`samples` independent draws per author: sample_no and length."""
    drawn = counts.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return drawn.withColumn("length", sampling.episode_length(
        seed, shortest, longest, F.col("author_id"), F.col("sample_no")))


def short_histories(samples: DataFrame) -> DataFrame:
    """Draws that do not fit into their history."""
    return samples.where(F.col("n") < F.col("length"))


def contiguous_spec(samples: DataFrame, seed: str, drop_short: bool = False) -> DataFrame:
    """A uniform start for every draw. A draw longer than its history is an error, unless `drop_short` leaves it out."""
    enough = F.col("n") >= F.col("length")
    if drop_short:
        fits = samples.where(enough)
    else:
        short = F.raise_error(F.concat(F.lit("too few posts for a draw of author "), F.col("author_id").cast("string")))
        fits = samples.withColumn("n", F.when(enough, F.col("n")).otherwise(short.cast("bigint")))
    return fits.withColumn("start", sampling.episode_start(
        seed, F.col("n"), F.col("length"), F.col("author_id"), F.col("sample_no")))


def spec_positions(spec: DataFrame) -> DataFrame:
    """(author_id, sample_no, ep_pos, pos) from (start, length)."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)
    opened = spec.where(F.col("length") > 0).select("author_id", "sample_no", "start", F.explode(steps).alias("ep_pos"))
    return opened.select("author_id", "sample_no", "ep_pos", (F.col("start") + F.col("ep_pos")).alias("pos"))


def random_positions(samples: DataFrame, seed: str) -> DataFrame:
    """Positions without replacement; a history shorter than the draw gives all its posts."""
    picked = sampling.distinct_positions(seed, F.col("n"), F.col("length"), F.col("author_id"), F.col("sample_no"))
    return samples.select("author_id", "sample_no", F.posexplode(picked).alias("ep_pos", "pos")).withColumn(
        "ep_pos", F.col("ep_pos").cast("bigint"))


def episode_posts(positions: DataFrame, posts: DataFrame) -> DataFrame:
    """The posts of every episode, long form. Positions are opened from a few rows; a planner that goes by the size before
    that would collect them all on the driver, so both sides are shuffled."""
    return positions.hint("merge").join(posts, ["author_id", "pos"])


def nest_episodes(members: DataFrame) -> DataFrame:
    """One row per episode; its size is bounded by the episode length. `num_posts` is the true count. Members without
    symbols may carry their number, `n_syms`, instead."""
    symbols = "syms" if "syms" in members.columns else "n_syms"
    item = F.struct("ep_pos", symbols, "hour", "minute", "day", F.col("action_id").cast("int").alias("action_type"))
    nested = members.groupBy("author_id", "sample_no").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return nested.select(
        "author_id", "sample_no", F.size("items").cast("bigint").alias("num_posts"), F.col(f"items.{symbols}").alias(symbols),
        F.col("items.hour").alias("hour"), F.col("items.minute").alias("minute"), F.col("items.day").alias("day"),
        F.col("items.action_type").alias("action_type"))


SEQUENCES = ("syms", "hour", "minute", "day", "action_type")


def _sequences(histories: DataFrame) -> list[str]:
    """Those that the histories have, all of one length."""
    return [c for c in SEQUENCES if c in histories.columns]


def _join_segments(parts: DataFrame) -> DataFrame:
    """Pieces of an episode from neighbouring segments of a long history, put together; bounded by its length."""
    names = _sequences(parts)
    joined = parts.groupBy("author_id").agg(F.sort_array(F.collect_list(F.struct("segment", *names))).alias("i"))
    return joined.select("author_id", *[F.flatten(F.col(f"i.{c}")).alias(c) for c in names])


def slice_histories(histories: DataFrame, spec: DataFrame, segment_posts: int = SEGMENT_POSTS) -> DataFrame:
    """Slice nested histories by (start, length) given per author; a slice may cross into the next segment."""
    base = F.col("segment") * segment_posts
    first = F.greatest(F.col("start") - base, F.lit(0))
    names = _sequences(histories)
    last = F.least(F.col("start") + F.col("length") - base, F.size(names[0]))
    parts = histories.join(spec, "author_id").withColumns({"_a": first, "_n": last - first}).where(F.col("_n") > 0)
    return _join_segments(parts.withColumns({c: slice_at(F.col(c), F.col("_a"), F.col("_n")) for c in names}))


def gather_histories(histories: DataFrame, picks: DataFrame, segment_posts: int = SEGMENT_POSTS) -> DataFrame:
    """Pick posts of nested histories by ascending `idx`, the same indices for all features."""
    names, base = _sequences(histories), F.col("segment") * segment_posts
    joined = histories.join(picks, "author_id").withColumn("_base", base)
    inside = F.filter("idx", lambda i: (i >= F.col("_base")) & (i < F.col("_base") + F.size(names[0])))
    parts = joined.withColumn("_i", F.transform(inside, lambda i: i - F.col("_base"))).where(F.size("_i") > 0)
    return _join_segments(parts.withColumns({c: gather(F.col(c), F.col("_i")) for c in names}))


def take_queries(records: DataFrame, count: int, key: str = "author_id") -> DataFrame:
    """First `count` records by key; zero or less means all. A filter on the key, whatever the count."""
    return records if count <= 0 else take_first(records, key, count)


def filter_authors(records: DataFrame, below: int) -> DataFrame:
    """Placed before sampling, so that the scan can skip the other authors."""
    return records.where(F.col("author_id") < below)


def filter_num_posts(counts: DataFrame, more_than: int) -> DataFrame:
    if more_than <= 1:
        raise ValueError("more_than must be above 1")
    return counts.where(F.col("n") > more_than)


def positive_pairs(samples: DataFrame) -> DataFrame:
    """Two independent draws of the same author: sample 0 with sample 1."""
    left = samples.where(F.col("sample_no") == 0).select("author_id", F.struct(*samples.columns).alias("left"))
    right = samples.where(F.col("sample_no") == 1).select("author_id", F.struct(*samples.columns).alias("right"))
    return left.join(right, "author_id").select("left", "right", F.lit(1).alias("is_same"))


def negative_pairs(samples: DataFrame, seed: str) -> DataFrame:
    """Sample 0 of every author with sample 2 of the next author in hash order: always two different authors."""
    authors = samples.where(F.col("sample_no") == 0).select("author_id")
    ring = number_rows(authors, sampling.hash32(seed + "/pairs", F.col("author_id")), ["author_id"], "number",
                       total="total").where(F.col("total") > 1)
    this = ring.select(F.col("author_id").alias("left_author"), ((F.col("number") + 1) % F.col("total")).alias("number"))
    following = ring.select(F.col("author_id").alias("right_author"), "number")
    matched = this.join(following, "number").select("left_author", "right_author")
    left = samples.where(F.col("sample_no") == 0).select(
        F.col("author_id").alias("left_author"), F.struct(*samples.columns).alias("left"))
    right = samples.where(F.col("sample_no") == 2).select(
        F.col("author_id").alias("right_author"), F.struct(*samples.columns).alias("right"))
    return matched.join(left, "left_author").join(right, "right_author").select(
        "left", "right", F.lit(0).alias("is_same"))


def labelled_pairs(samples: DataFrame, seed: str) -> DataFrame:
    """All positives, then all negatives. The samples are read six times, hence written once."""
    samples = settle(samples)
    return positive_pairs(samples).unionByName(negative_pairs(samples, seed))


def shuffle_records(records: DataFrame, seed: str, *keys: str) -> DataFrame:
    """A repeatable random order: a distributed sort by hash."""
    return records.withColumn("draw", sampling.hash32(seed, *[F.col(k) for k in keys])).orderBy("draw", *keys)


def repeat_epochs(records: DataFrame, epochs: int) -> DataFrame:
    return records.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))

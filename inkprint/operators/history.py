"""Per-author histories: ordering, lookups, slicing and nesting.

Posts are long rows (author_id, pos, ...). Only the last step nests them, and it nests per (author, segment) of
`segment_posts` positions: a usual history is one row, a very long one is several rows of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from inkprint.functions import arrays, calendar
from inkprint.functions.sampling import hash32
from inkprint.operators.joins import join_dimension
from inkprint.operators.prefix import number_rows, running_sums
from inkprint.session import broadcast_if_small, settle

SEGMENT_POSTS = 1024
UNKNOWN_ACTION = "<unk>"
MAX_BROADCAST_ACTIONS = 65_536


def timeline(posts: DataFrame, author: str = "author", time: str = "created_utc", tie: str = "post_id",
             bucket_seconds: int = 3600) -> DataFrame:
    """Add `pos`, the place of each post in its author's history by (time, tie).

    Numbered inside (author, hour) and shifted by the count of earlier hours, so an author with a third of all
    posts is spread over as many tasks as they have active hours.
    """
    placed = posts.withColumn("_bucket", F.floor(F.col(time) / bucket_seconds))
    numbered = running_sums(placed, [F.col(time), F.col(tie)], {"pos": F.lit(1)}, keys=[author])
    return numbered.withColumn("pos", F.col("pos") - 1).drop("_bucket")


def renumber(posts: DataFrame, author: str = "author", run: int = SEGMENT_POSTS) -> DataFrame:
    """Close the gaps in `pos` after posts were removed, so that the place in the list is the position again. Counted
    inside runs of `run` old positions, so a long history is spread over many tasks."""
    placed = posts.withColumn("_bucket", F.floor(F.col("pos") / run)).withColumnRenamed("pos", "_old")
    numbered = running_sums(placed, [F.col("_old")], {"pos": F.lit(1)}, keys=[author])
    return numbered.withColumn("pos", F.col("pos") - 1).select(*posts.columns)


def with_segment(posts: DataFrame, segment_posts: int = SEGMENT_POSTS) -> DataFrame:
    return posts.withColumn("segment", F.floor(F.col("pos") / segment_posts))


def id_lines(history: DataFrame, segment_posts: int = SEGMENT_POSTS) -> DataFrame:
    """Text lines of post ids in history order, one per (author, segment). A line that goes on with a long history
    begins with `@first:pos`, the author's first id and the position of the line's first post."""
    ids = F.sort_array(F.collect_list(F.struct("pos", F.col("post_id").cast("string").alias("post_id"))))
    lines = settle(with_segment(history, segment_posts).groupBy("author", "segment").agg(ids.alias("ids")))
    head = lines.groupBy("author").agg(F.min_by(F.col("ids")[0]["post_id"], "segment").alias("first"),
                                       F.min("segment").alias("segment_0"))
    mark = F.when(F.col("segment") > F.col("segment_0"), F.concat(
        F.lit("@"), "first", F.lit(":"), F.col("ids")[0]["pos"].cast("string"), F.lit(" "))).otherwise(F.lit(""))
    return lines.join(head, "author").select(F.concat(mark, F.array_join(F.col("ids.post_id"), " ")).alias("value"))


def dense_ids(values: DataFrame, column: str, name: str, seed: str = "ids") -> DataFrame:
    """Distinct values with consecutive ids from 0, in hash order (any order will do, this one repeats)."""
    distinct = settle(values.select(column).where(F.col(column).isNotNull()).distinct())
    return number_rows(distinct, hash32(seed, F.col(column)), [column], name)


def join_author_id(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Author name to dense id, whichever author holds how many posts."""
    return join_dimension(posts, ids, "author", "post_id")


def authors_in_many_files(posts: DataFrame) -> DataFrame:
    """Authors whose posts come from more than one input file; expected to be empty for pre-split input."""
    files = posts.select("author", F.col("_metadata.file_path").alias("file"))
    return files.groupBy("author").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").select("author")


def join_posts(ids: DataFrame, posts: DataFrame) -> DataFrame:
    """Look up listed ids. Keys are unique on the post side, so the shuffle on post_id has no skew."""
    return ids.join(posts, "post_id")


def missing_posts(ids: DataFrame, posts: DataFrame) -> DataFrame:
    """Listed ids without a post; the caller treats any row as an error."""
    return ids.join(posts.select("post_id"), "post_id", "left_anti")


def exclude_heldout(posts: DataFrame, heldout: DataFrame) -> DataFrame:
    return posts.join(heldout.select("post_id"), "post_id", "left_anti")


def join_sample_spec(history: DataFrame, spec: DataFrame) -> DataFrame:
    """Only sampled authors, only positions [start_index, start_index + episode_length).

    The spec is opened to one row per wanted position: the join key (author, pos) is unique on both sides. Both are
    shuffled, as the planner knows only the size before the opening.
    """
    wanted = spec.select(
        "author", "start_index", "episode_length",
        F.explode(F.sequence(F.col("start_index"), F.col("start_index") + F.col("episode_length") - 1)).alias("pos"))
    return history.join(wanted.hint("merge"), ["author", "pos"])


def sample_spec_violations(history: DataFrame, spec: DataFrame) -> DataFrame:
    """Sampled authors whose history length differs from the spec, or is too short for the slice."""
    counts = history.groupBy("author").agg(F.count("*").alias("n"))
    joined = spec.join(counts, "author")
    bad = (F.col("n") != F.col("num_actions_total")) | (F.col("start_index") + F.col("episode_length") > F.col("n"))
    return joined.where(bad)


def lookup_action(posts: DataFrame, actions: DataFrame, column: str = "community") -> DataFrame:
    """Community name to action id; unknown names get the id of the unknown entry.

    The dimension holds at most num_action_types rows (operators/vocab.py) and is broadcast only within that
    bound; a larger one is left to the planner.
    """
    named = actions.select(F.col("action").alias(column), "action_id")
    unknown = actions.agg(F.max(F.when(F.col("action") == UNKNOWN_ACTION, F.col("action_id")))).first()[0]
    if unknown is None:
        raise ValueError(f"the action dimension has no {UNKNOWN_ACTION} entry")
    side = broadcast_if_small(named, MAX_BROADCAST_ACTIONS)
    return posts.join(side, column, "left").withColumn("action_id", F.coalesce("action_id", F.lit(unknown)))


def with_calendar(posts: DataFrame, epoch: str = "created_utc") -> DataFrame:
    at = F.col(epoch)
    return posts.withColumns({
        "hour": calendar.hour_of(at), "minute": calendar.minute_of(at), "day": calendar.weekday_of(at)})


def assemble_history(posts: DataFrame, authors: DataFrame, segment_posts: int = SEGMENT_POSTS) -> DataFrame:
    """Nest posts to HISTORY rows in order of `pos`. Segment 0 exists for every author, with empty lists when all
    posts were removed: author markers join the same group-by instead of needing a join.

    Rows have lists of those features that the posts have. Symbols below 65,536 may come as `packed` of
    functions/arrays.py: they travel in two bytes each and are opened behind the shuffle."""
    features = {"syms": F.col("syms"), "packed": F.col("packed"), "hour": F.col("hour"), "minute": F.col("minute"),
                "day": F.col("day"), "action_id": F.col("action_id").cast("int").alias("action_type")}
    item = F.struct("pos", *[c for name, c in features.items() if name in posts.columns])
    rows = with_segment(posts, segment_posts).select("author_id", "segment", item.alias("item"))
    markers = authors.select("author_id", F.lit(0).cast("bigint").alias("segment"),
                             F.lit(None).cast(rows.schema["item"].dataType).alias("item"))
    every, names = rows.unionByName(markers), rows.schema["item"].dataType.names[1:]
    if "packed" in names:
        return _nest_packed(every.select("author_id", "segment", "item.*"), names)
    nested = every.groupBy("author_id", "segment").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return nested.select("author_id", "segment", *[F.col(f"items.{c}").alias(c) for c in names])


def _nest_packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per (author, segment); a group has at most `segment_posts` posts, and an empty row where it has none."""
    columns = ["syms" if c == "packed" else c for c in names]

    def nest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        posts = table.filter(table.column("pos").is_valid()).combine_chunks()
        order = [("pos", "ascending"), ("packed", "ascending")]
        posts = posts.take(pc.sort_indices(posts, sort_keys=order, null_placement="at_start"))
        lists = []
        for c in names:
            values = pa.concat_arrays(posts.column(c).chunks) if len(posts) else pa.array([], posts.schema.field(c).type)
            values = arrays.unpacked(values) if c == "packed" else values.cast(pa.int32())
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + lists, names=["author_id", "segment", *columns])

    schema = ", ".join(f"{c} array<{'array<int>' if c == 'syms' else 'int'}>" for c in columns)
    return rows.groupBy("author_id", "segment").applyInArrow(nest, f"author_id bigint, segment bigint, {schema}")


def posts_per_author(posts: DataFrame, author: str = "author_id") -> DataFrame:
    return posts.groupBy(author).agg(
        F.count("*").alias("num_posts"), F.sum(F.size("syms").cast("bigint")).alias("num_symbols"))

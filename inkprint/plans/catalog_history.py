"""Histories, lookups and ragged records."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions import arrays, calendar
from inkprint.operators import episodes, history, records
from inkprint.operators.prefix import running_sums
from inkprint.plans import inputs, sqlparts as q
from inkprint.plans.catalog_sources import HISTORY_ROWS, history_rows, record_rows
from inkprint.plans.registry import query


@query("join_posts", f"WITH {q.TL} SELECT author, pos, post_id, community, created_utc FROM tl")
def join_posts(spark, sf):
    ids = inputs.timeline(spark, sf).select("author", "pos", "post_id")
    found = history.join_posts(ids, inputs.events(spark, sf).drop("author"))
    return found.select("author", "pos", "post_id", "community", "created_utc")


@query("missing_posts", """
SELECT event_id AS post_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)""")
def missing_posts(spark, sf):
    """Ids without a post; here, event ids that no document carries."""
    ids = inputs.events(spark, sf).select("post_id")
    return history.missing_posts(ids, inputs.documents(spark, sf).select(F.col("doc_id").alias("post_id")))


DENSE = f"""dense AS (
  SELECT author, row_number() OVER (ORDER BY {q.hash32('ids', 'author')}, author) - 1 AS author_id
  FROM (SELECT DISTINCT author FROM ev))"""


@query("dense_ids", f"WITH {q.EV}, {DENSE} SELECT author, author_id FROM dense")
def dense_ids(spark, sf):
    return history.dense_ids(inputs.events(spark, sf), "author", "author_id")


@query("join_author_id", f"WITH {q.EV}, {DENSE} SELECT post_id, author, author_id FROM ev JOIN dense USING (author)")
def join_author_id(spark, sf):
    events = inputs.events(spark, sf).select("post_id", "author")
    ids = history.dense_ids(events, "author", "author_id")
    return history.join_author_id(events, ids).select("post_id", "author", "author_id")


@query("lookup_action", f"""
WITH {q.EV}, {q.ACTIONS}
SELECT post_id, community, coalesce(action_id, 4) AS action_id FROM ev LEFT JOIN act ON act.action = community""")
def lookup_action(spark, sf):
    events = inputs.events(spark, sf).select("post_id", "community")
    return history.lookup_action(events, inputs.actions(spark, sf)).select("post_id", "community", "action_id")


@query("exclude_heldout", f"WITH {q.TL} SELECT author, pos, post_id FROM tl WHERE community <> 'error'")
def exclude_heldout(spark, sf):
    return history.exclude_heldout(inputs.timeline(spark, sf), inputs.heldout(spark, sf)).select("author", "pos", "post_id")


@query("join_sample_spec", f"WITH {q.TL} SELECT author, pos, post_id FROM tl WHERE pos BETWEEN 3 AND 18")
def join_sample_spec(spark, sf):
    return history.join_sample_spec(inputs.timeline(spark, sf), inputs.sample_spec(spark, sf)).select(
        "author", "pos", "post_id")


@query("sample_spec_violations", """
SELECT CAST(user_id AS VARCHAR) AS author, count(*) AS n FROM events GROUP BY user_id HAVING count(*) < 60""")
def sample_spec_violations(spark, sf):
    """A spec that asks for 60 posts of every author: the short ones are reported."""
    spec = inputs.sample_spec(spark, sf).withColumn("start_index", F.lit(44).cast("bigint"))
    return history.sample_spec_violations(inputs.events(spark, sf), spec).select("author", "n")


@query("author_distinct", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS author, false AS in_many_files FROM events")
def author_distinct(spark, sf):
    base = inputs.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("author"), "_metadata.file_path")
    files = base.groupBy("author").agg((F.min("file_path") != F.max("file_path")).alias("in_many_files"))
    return files


@query("assemble_history", f"WITH {q.HIST} {HISTORY_ROWS} FROM hist")
def assemble_history(spark, sf):
    return history_rows(inputs.histories(spark, sf))


def thinned(where: str, authors: str = "SELECT DISTINCT author_id FROM ep") -> str:
    """SQL twin: posts that fulfil a condition, positions closed up, nested for every listed author."""
    return f"""k AS (SELECT * REPLACE (row_number() OVER (PARTITION BY author_id ORDER BY pos) - 1 AS pos) FROM ep WHERE {where}),
hist AS (
  SELECT a.author_id, coalesce(pos // 1024, 0) AS segment, coalesce(list(syms ORDER BY pos) FILTER (pos IS NOT NULL), []) AS syms,
         coalesce(list(hour ORDER BY pos) FILTER (pos IS NOT NULL), []) AS hour,
         coalesce(list(minute ORDER BY pos) FILTER (pos IS NOT NULL), []) AS minute,
         coalesce(list(day ORDER BY pos) FILTER (pos IS NOT NULL), []) AS day,
         coalesce(list(action_id ORDER BY pos) FILTER (pos IS NOT NULL), []) AS action_type
  FROM ({authors}) a LEFT JOIN k ON k.author_id = a.author_id GROUP BY 1, 2)"""


@query("assemble_without_heldout", f"""
WITH {q.EP}, {thinned("community <> 'error'")}
{HISTORY_ROWS} FROM hist""")
def assemble_without_heldout(spark, sf):
    """The whole preprocessing: order, remove held-out posts, close the gaps, look up, nest; authors left without posts
    stay."""
    kept = history.renumber(history.exclude_heldout(inputs.timeline(spark, sf), inputs.heldout(spark, sf)))
    posts = inputs.encoded_posts(spark, sf, kept, pack=True)
    return history_rows(history.assemble_history(posts, inputs.authors(spark, sf)))


@query("preprocess_with_spec", f"""
WITH {q.EP}, {thinned("community <> 'error' AND pos BETWEEN 3 AND 18")},
rec AS (SELECT author_id, segment, len(syms) AS num_posts, md5({q.joined('flatten(syms)')}) AS syms_md5,
               {q.joined('list_transform(syms, lambda r: len(r))')} AS lens, {q.joined('hour')} AS hours,
               {q.joined('action_type')} AS actions FROM hist)
SELECT * FROM rec""")
def preprocess_with_spec(spark, sf):
    """The preprocessing of a sampled set, in its order: slice by the spec, remove held-out posts, close the gaps, fetch
    and look up, nest, flatten to records. A sampled author whose posts are all removed stays, with an empty record."""
    sliced = history.join_sample_spec(inputs.timeline(spark, sf), inputs.sample_spec(spark, sf))
    kept = history.renumber(history.exclude_heldout(sliced, inputs.heldout(spark, sf)))
    posts = inputs.encoded_choice(spark, sf, kept).withColumn("author_id", F.col("author").cast("bigint"))
    sampled = inputs.sample_spec(spark, sf).select(F.col("author").cast("bigint").alias("author_id"))
    return record_rows(records.ragged_features(history.assemble_history(posts, sampled)))


@query("posts_per_author", f"""
WITH {q.EP} SELECT author_id, count(*) AS num_posts, sum(len(syms))::BIGINT AS num_symbols FROM ep GROUP BY author_id""")
def posts_per_author(spark, sf):
    return history.posts_per_author(inputs.encoded_posts(spark, sf))


for _name, _expr, _sql in (
    ("hour_of", calendar.hour_of, "hour(ts)"),
    ("minute_of", calendar.minute_of, "minute(ts)"),
    ("weekday_of", calendar.weekday_of, "isodow(ts) - 1"),
):
    def _calendar_query(spark, sf, expr=_expr, name=_name):
        return inputs.events(spark, sf).select("post_id", expr(F.col("created_utc")).cast("bigint").alias(name))

    query(_name, f"SELECT event_id AS post_id, {_sql} AS {_name} FROM events")(_calendar_query)


@query("cumulative_counts", """
SELECT event_id AS post_id,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w::BIGINT AS cum_pos,
       sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w::BIGINT AS cum_neg
FROM events WINDOW w AS (ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative_counts(spark, sf):
    """Running counts of two classes over a global order, here `value`, in range buckets."""
    from inkprint.operators.prefix import with_range_bucket

    rows = inputs.table(spark, sf, "events").select("value", F.col("event_id").alias("post_id"), "event_type")
    placed = with_range_bucket(rows, ["value", "post_id"], spark.sparkContext.defaultParallelism)
    is_pos = (F.col("event_type") == "error").cast("int")
    running = running_sums(placed, [F.col("value"), F.col("post_id")], {"cum_pos": is_pos, "cum_neg": 1 - is_pos})
    return running.select("post_id", "cum_pos", "cum_neg")


# --- ragged records ---------------------------------------------------------------------------------------------

THREADS = f"""th AS (SELECT conv_id AS author_id, turn AS pos, role, text, {q.syms('text')} AS syms FROM conversations),
hist AS (SELECT author_id, list(syms ORDER BY pos) AS syms FROM th GROUP BY author_id, pos // 1024)"""
ROWS = "array_to_string(list_transform({}, lambda r: array_to_string(r, ',')), ';')"


def thread_histories(spark, sf):
    """Conversations nested like histories, per segment of bounded size."""
    items = F.sort_array(F.collect_list(F.struct("pos", "syms")))
    threads = history.with_segment(inputs.thread_posts(spark, sf))
    return threads.groupBy("author_id", "segment").agg(items.alias("i")).select(
        "author_id", "segment", F.col("i.syms").alias("syms"))


@query("truncate_symbols", f"""
WITH {THREADS} SELECT author_id, md5({ROWS.format('list_transform(syms, lambda r: r[1:32])')}) AS syms_md5 FROM hist""")
def truncate_symbols(spark, sf):
    cut = records.truncate_symbols(thread_histories(spark, sf))
    return cut.select("author_id", F.md5(arrays.joined_rows(F.col("syms"))).alias("syms_md5"))


@query("ragged_features", f"""
WITH {THREADS}, c AS (SELECT author_id, syms AS s FROM hist)
SELECT author_id, len(s) AS num_posts, {q.joined('list_transform(s, lambda r: len(r))')} AS lens,
       md5({q.joined('flatten(s)')}) AS syms_md5 FROM c""")
def ragged_features(spark, sf):
    made = records.ragged_features(thread_histories(spark, sf))
    return made.select("author_id", "num_posts", arrays.joined(F.col("lens")).alias("lens"),
                       F.md5(arrays.joined(F.col("syms"))).alias("syms_md5"))


@query("unflatten", f"WITH {THREADS} SELECT author_id, len(syms) AS n_rows, md5({ROWS.format('syms')}) AS syms_md5 FROM hist")
def unflatten(spark, sf):
    """Flat values and lengths back to rows: the nested form of the whole posts returns."""
    flat = records.ragged_features(thread_histories(spark, sf))
    nested = records.nested_symbols(flat)
    return nested.select("author_id", F.size("syms").cast("bigint").alias("n_rows"),
                         F.md5(arrays.joined_rows(F.col("syms"))).alias("syms_md5"))


PADDED = "list_transform(syms, lambda r: list_resize(r[1:32], 32, 0::BIGINT))"


@query("pad_posts", f"WITH {THREADS} SELECT author_id, md5({ROWS.format(PADDED)}) AS syms_md5 FROM hist")
def pad_posts(spark, sf):
    padded = records.pad_posts(records.ragged_features(thread_histories(spark, sf), records.MAX_POST_SYMBOLS))
    return padded.select("author_id", F.md5(arrays.joined_rows(F.col("syms"))).alias("syms_md5"))


@query("pad_episodes", f"""
WITH {THREADS}, g AS (SELECT *, max(len(syms)) OVER (PARTITION BY author_id // 64) AS longest FROM hist)
SELECT author_id, longest, {q.joined('list_resize(list_transform(syms, lambda r: len(r)), longest, 0::BIGINT)')} AS lens FROM g""")
def pad_episodes(spark, sf):
    """Pad every sequence to the longest of its group. The longest is one number per group, joined back."""
    rows = thread_histories(spark, sf).withColumn("grp", F.floor(F.col("author_id") / 64)).withColumn(
        "lens", arrays.row_lengths(F.col("syms")))
    longest = rows.groupBy("grp").agg(F.max(F.size("lens")).alias("longest"))
    padded = F.concat("lens", F.array_repeat(F.lit(0), F.col("longest") - F.size("lens")))
    return rows.join(longest, "grp").select(
        "author_id", F.col("longest").cast("bigint").alias("longest"), arrays.joined(padded).alias("lens"))


@query("sequence_mask", """
WITH n AS (SELECT conv_id AS author_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT author_id, array_to_string(list_transform(range(16), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END), ',') AS mask FROM n""")
def sequence_mask(spark, sf):
    counts = inputs.thread_posts(spark, sf).groupBy("author_id").agg(F.count("*").alias("n"))
    mask = F.transform(arrays.sequence_mask(F.col("n"), 16), lambda b: b.cast("int"))
    return counts.select("author_id", arrays.joined(mask).alias("mask"))


@query("one_hot_time", """
SELECT event_id AS post_id,
  array_to_string(list_transform(range(24), lambda i: CASE WHEN i = hour(ts) THEN 1 ELSE 0 END), '') AS hour_hot,
  array_to_string(list_transform(range(7), lambda i: CASE WHEN i = isodow(ts) - 1 THEN 1 ELSE 0 END), '') AS day_hot
FROM events""")
def one_hot_time(spark, sf):
    posts = history.with_calendar(inputs.events(spark, sf))

    def bits(column):
        return F.array_join(column.cast("array<string>"), "")

    return posts.select("post_id", bits(arrays.one_hot(F.col("hour"), 24)).alias("hour_hot"),
                        bits(arrays.one_hot(F.col("day"), 7)).alias("day_hot"))


@query("select_features", f"""
WITH {q.HIST} SELECT author_id, segment, len(syms) AS num_posts, {q.joined('hour')} AS hours, {q.joined('day')} AS days
FROM hist""")
def select_features(spark, sf):
    config = records.FeatureConfig(sequence_features=["hour", "day"])
    chosen = records.select_features(records.ragged_features(inputs.histories(spark, sf)), config)
    return chosen.select("author_id", "segment", "num_posts", arrays.joined(F.col("hour")).alias("hours"),
                         arrays.joined(F.col("day")).alias("days"))


@query("split_label", f"""
WITH {q.HIST} SELECT author_id AS label, segment, len(syms) AS num_posts, {q.joined('hour')} AS hours FROM hist""")
def split_label(spark, sf):
    config = records.FeatureConfig(sequence_features=["hour"])
    split = records.split_label(records.ragged_features(inputs.histories(spark, sf)), config)
    return split.select("label", "segment", F.col("features.num_posts").alias("num_posts"),
                        arrays.joined(F.col("features.hour")).alias("hours"))


@query("validate_histories", "SELECT count(DISTINCT user_id) AS n_rows, 0::BIGINT AS n_empty, 0::BIGINT AS n_invalid FROM events")
def validate_histories(spark, sf):
    return records.history_violations(inputs.histories(spark, sf))


@query("validate_records", "SELECT count(DISTINCT user_id) AS n_rows, 0::BIGINT AS n_bad_length, 0::BIGINT AS n_bad_posts FROM events")
def validate_records(spark, sf):
    return records.record_violations(records.ragged_features(inputs.histories(spark, sf)))


@query("truncate_episode_posts", "SELECT conv_id AS author_id, turn AS pos, md5(text) AS text_md5 FROM conversations WHERE turn < 4")
def truncate_episode_posts(spark, sf):
    from inkprint.operators.tfidf import first_posts

    return first_posts(inputs.thread_posts(spark, sf), 4).select("author_id", "pos", F.md5("text").alias("text_md5"))


@query("filter_authors", "SELECT user_id AS author_id, count(*) AS n FROM events WHERE user_id < 100 GROUP BY user_id")
def filter_authors(spark, sf):
    rows = inputs.table(spark, sf, "events").select(F.col("user_id").alias("author_id"))
    return episodes.author_counts(episodes.filter_authors(rows, 100))


@query("filter_num_posts", "SELECT user_id AS author_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 64")
def filter_num_posts(spark, sf):
    rows = inputs.table(spark, sf, "events").select(F.col("user_id").alias("author_id"))
    return episodes.filter_num_posts(episodes.author_counts(rows), 64)

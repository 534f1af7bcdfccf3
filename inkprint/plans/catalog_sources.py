"""Sources and sinks: the driver tables are written in the reference's file formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions.arrays import joined, joined_rows
from inkprint.operators import episodes, history, ranking, records, tfidf, vocab
from inkprint.operators.prefix import take_first
from inkprint.plans import inputs, sqlparts as q
from inkprint.plans.registry import query
from inkprint.session import staging_path
from inkprint.sources import readers, writers

HISTORY_ROWS = """
SELECT author_id, segment, len(syms) AS num_posts, md5({syms}) AS syms_md5, {hour} AS hours, {minute} AS minutes,
       {day} AS days, {action} AS actions
""".format(syms="array_to_string(list_transform(syms, lambda r: array_to_string(r, ',')), ';')",
           hour=q.joined("hour"), minute=q.joined("minute"), day=q.joined("day"), action=q.joined("action_type"))


def history_rows(df):
    return df.select(
        "author_id", "segment", F.size("syms").cast("bigint").alias("num_posts"),
        F.md5(joined_rows(F.col("syms"))).alias("syms_md5"), joined(F.col("hour")).alias("hours"),
        joined(F.col("minute")).alias("minutes"), joined(F.col("day")).alias("days"),
        joined(F.col("action_type")).alias("actions"))


@query("scan_posts", f"""
WITH {q.EV}
SELECT post_id, author, community, created_utc, length(text) AS n_chars, md5(text) AS body_md5
FROM ev JOIN documents ON doc_id = post_id % (SELECT count(*) FROM documents)""")
def scan_posts(spark, sf):
    path = inputs.staged(spark, sf, "posts", lambda p: inputs.posts(spark, sf).write.parquet(p))
    return readers.read_posts(spark, path).select(
        "post_id", "author", "community", "created_utc", F.length("body").cast("bigint").alias("n_chars"),
        F.md5("body").alias("body_md5"))


@query("scan_comments_json", "SELECT doc_id AS post_id, source AS community, md5(text) AS body_md5 FROM documents")
def scan_comments_json(spark, sf):
    rows = inputs.documents(spark, sf).select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("body"), F.col("source").alias("community"))
    path = inputs.staged(spark, sf, "comments", lambda p: writers.write_json(rows, p))
    return readers.read_comments(spark, path).select("post_id", "community", F.md5("body").alias("body_md5"))


@query("scan_wiki_json", "SELECT doc_id AS article_id, md5(text) AS text_md5 FROM documents WHERE lang <> 'de'")
def scan_wiki_json(spark, sf):
    """Documents of one language stand for articles without the text field: the writer omits null fields."""
    rows = inputs.documents(spark, sf).select(
        F.col("doc_id").alias("article_id"), F.when(F.col("lang") != "de", F.col("text")).alias("cleaned_content"))
    path = inputs.staged(spark, sf, "articles", lambda p: writers.write_json(rows, p))
    return readers.read_articles(spark, path).select("article_id", F.md5("cleaned_content").alias("text_md5"))


@query("scan_id_lists", f"""
WITH {q.TL}
SELECT first_value(post_id) OVER (PARTITION BY author ORDER BY pos) AS first_id, pos, post_id FROM tl""")
def scan_id_lists(spark, sf):
    lines = history.id_lines(inputs.timeline(spark, sf))
    path = inputs.staged(spark, sf, "id_lists", lambda p: writers.write_lines(lines, p))
    return readers.read_id_lists(spark, path)


@query("scan_heldout_ids", "SELECT event_id AS post_id FROM events WHERE event_type = 'error'")
def scan_heldout_ids(spark, sf):
    """Every line names its id twice; the reader returns a set."""
    ids = inputs.heldout(spark, sf).select(F.concat_ws(" ", "post_id", "post_id").alias("value"))
    path = inputs.staged(spark, sf, "heldout", lambda p: writers.write_lines(ids, p))
    return readers.read_heldout_ids(spark, path)


@query("scan_sample_spec", """
SELECT CAST(user_id AS VARCHAR) AS author, count(*) AS num_actions_total, 3::BIGINT AS start_index,
       16::BIGINT AS episode_length
FROM events GROUP BY user_id""")
def scan_sample_spec(spark, sf):
    path = inputs.staged(spark, sf, "spec", lambda p: writers.write_json(inputs.sample_spec(spark, sf), p))
    return readers.read_sample_spec(spark, path)


def staged_histories(spark, sf):
    path = inputs.staged(spark, sf, "histories", lambda p: writers.write_histories(inputs.history_parts(spark, sf), p))
    return readers.read_histories(spark, path)


@query("scan_histories", f"WITH {q.HIST} {HISTORY_ROWS} FROM hist")
def scan_histories(spark, sf):
    return history_rows(staged_histories(spark, sf))


RECORD_SQL = f"""
WITH {q.HIST}
SELECT author_id, segment, len(syms) AS num_posts, md5({q.joined('flatten(syms)')}) AS syms_md5,
       {q.joined('list_transform(syms, lambda r: len(r))')} AS lens, {q.joined('hour')} AS hours,
       {q.joined('action_type')} AS actions
FROM hist"""


def whole_records(spark, sf):
    return records.ragged_features(inputs.histories(spark, sf), max_length=None)


def record_rows(df):
    return df.select(
        "author_id", "segment", "num_posts", F.md5(joined(F.col("syms"))).alias("syms_md5"), joined(F.col("lens")).alias("lens"),
        joined(F.col("hour")).alias("hours"), joined(F.col("action_type")).alias("actions"))


@query("scan_records", RECORD_SQL)
def scan_records(spark, sf):
    path = inputs.staged(spark, sf, "records", lambda p: writers.write_records(
        whole_records(spark, sf), p, records.FeatureConfig()))
    return record_rows(readers.read_records(spark, path))


INDEX_SQL = f"""
WITH n AS (SELECT user_id AS author_id, count(*) AS n FROM events GROUP BY user_id)
SELECT author_id, {q.hash32('index/start', 'author_id', '0')} % (n - 16 + 1) AS start, 16::BIGINT AS length
FROM n WHERE n >= 16"""


def episode_index(spark, sf):
    counts = inputs.events(spark, sf).groupBy(F.col("author").cast("bigint").alias("author_id")).agg(
        F.count("*").alias("n"))
    return episodes.contiguous_spec(
        episodes.draw_samples(counts, "index"), "index", drop_short=True).select("author_id", "start", "length")


@query("scan_episode_index", INDEX_SQL)
def scan_episode_index(spark, sf):
    path = inputs.staged(spark, sf, "index", lambda p: episode_index(spark, sf).write.parquet(p))
    return readers.read_episode_index(spark, path)


@query("scan_limited_posts", "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 500000")
def scan_limited_posts(spark, sf):
    return take_first(inputs.documents(spark, sf), "doc_id", 500_000).select("doc_id", F.md5("text").alias("text_md5"))


@query("scan_query_target", f"""
WITH {q.EMB}
SELECT CASE WHEN id % 2 = 0 THEN 'query' ELSE 'target' END AS side, id, label, round(list_sum(vec), 6) + 0.0::DOUBLE AS total
FROM emb""")
def scan_query_target(spark, sf):
    queries, targets = inputs.sides(spark, sf)
    left = inputs.staged(spark, sf, "queries", lambda p: writers.write_embeddings(queries, p))
    right = inputs.staged(spark, sf, "targets", lambda p: writers.write_embeddings(targets, p))
    a, b = readers.read_query_target(spark, left, right)
    both = a.withColumn("side", F.lit("query")).unionByName(b.withColumn("side", F.lit("target")))
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return both.select("side", "id", "label", (F.round(total, 6) + 0.0).alias("total"))


@query("write_histories", f"WITH {q.HIST} {HISTORY_ROWS} FROM hist")
def write_histories(spark, sf):
    path = staging_path(spark, "write_histories")
    writers.write_histories(inputs.history_parts(spark, sf), path)
    return history_rows(readers.read_histories(spark, path))


@query("write_records", RECORD_SQL)
def write_records(spark, sf):
    path = staging_path(spark, "write_records")
    writers.write_records(whole_records(spark, sf), path, records.FeatureConfig())
    return record_rows(readers.read_records(spark, path))


@query("write_corpus", f"""
SELECT md5(replace(text, chr(10), ' ')) AS line_md5, count(*) AS n FROM documents WHERE {q.keep('text')} GROUP BY 1""")
def write_corpus(spark, sf):
    path = staging_path(spark, "write_corpus")
    writers.write_corpus(vocab.corpus_lines(inputs.documents(spark, sf), "text"), path, "text")
    return spark.read.text(path).groupBy(F.md5("value").alias("line_md5")).agg(F.count("*").alias("n"))


@query("write_action_log", f"SELECT doc_id, source AS action FROM documents WHERE {q.keep('text')}")
def write_action_log(spark, sf):
    return vocab.kept_posts(inputs.documents(spark, sf), "text").select("doc_id", F.col("source").alias("action"))


@query("write_dimension", f"""
SELECT author, row_number() OVER (ORDER BY {q.hash32('ids', 'author')}, author) - 1 AS author_id
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS author FROM events)""")
def write_dimension(spark, sf):
    path = staging_path(spark, "write_dimension")
    writers.write_dimension(history.dense_ids(inputs.events(spark, sf), "author", "author_id"), path)
    return spark.read.parquet(path)


@query("write_embeddings", f"""
WITH {q.MEANS}
SELECT label * 2 + side AS id, label, round(list_sum(vec), 6) + 0.0::DOUBLE AS total FROM means""")
def write_embeddings(spark, sf):
    rows = inputs.embeddings(spark, sf).withColumn("side", F.col("id") % 2)
    means = ranking.mean_embedding(rows, ["label", "side"]).withColumn("id", F.col("label") * 2 + F.col("side"))
    path = staging_path(spark, "write_embeddings")
    writers.write_embeddings(means, path)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return spark.read.parquet(path).select("id", "label", (F.round(total, 6) + 0.0).alias("total"))


@query("write_metrics", f"""
WITH s AS (SELECT count(*)::DOUBLE AS n_total, count(*) FILTER ({q.keep('text')})::DOUBLE AS n_kept FROM documents)
SELECT 'n_total' AS name, n_total AS value FROM s UNION ALL SELECT 'n_kept', n_kept FROM s""")
def write_metrics(spark, sf):
    path = staging_path(spark, "write_metrics")
    writers.write_metrics(vocab.corpus_stats(inputs.documents(spark, sf), "text"), path)
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("name"), parts[1].cast("double").alias("value"))


@query("save_tfidf_model", f"""
WITH docs AS (SELECT doc_id AS doc, text FROM documents), {q.TFIDF}
SELECT term, term_id, df, total_tf, round(idf, 6) AS idf FROM model""")
def save_tfidf_model(spark, sf):
    path = staging_path(spark, "tfidf_model")
    writers.write_tfidf_model(tfidf.fit_tfidf(inputs.texts(spark, sf)), path)
    return spark.read.parquet(path).select(
        "term", F.col("term_id").cast("bigint").alias("term_id"), "df", "total_tf", F.round("idf", 6).alias("idf"))

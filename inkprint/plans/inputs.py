"""The driver tables in the shape of the operators' inputs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkprint.functions.arrays import packed
from inkprint.functions.text import hashed_symbols, words
from inkprint.operators import history, ranking, subword
from inkprint.session import settle, spread, staging_path

NUM_SYMBOLS = 65536
ACTION_VOCAB = 5
HELDOUT_TYPE = "error"
SUBWORD_SIZE = 32_768
PART_POSTS = 4_000_000  # a part of the histories has so many posts at least
PART_TEXTS = 2  # and so many times the texts, as every part moves them all


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work that is heavy per text."""
    return spread(documents(spark, sf), "doc_id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """post_id, author, community, created_utc. The time stamp has no zone and is read as UTC."""
    ts = F.col("ts")
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    epoch = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("post_id"), F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("community"), epoch.alias("created_utc"))


def with_doc(posts: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """Attach document columns to posts: post i carries document i mod n."""
    return posts.withColumn("doc_id", F.col("post_id") % n_docs).join(docs, "doc_id")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("body"))
    return with_doc(events(spark, sf), docs, docs.count()).select(
        "post_id", "author", "body", "community", "created_utc")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return history.timeline(events(spark, sf))


def heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out ids: all posts of one community."""
    return events(spark, sf).where(F.col("community") == HELDOUT_TYPE).select("post_id")


def sample_spec(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("author").agg(F.count("*").alias("num_actions_total")).select(
        "author", "num_actions_total", F.lit(3).cast("bigint").alias("start_index"),
        F.lit(16).cast("bigint").alias("episode_length"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    from inkprint.operators import vocab

    return vocab.action_vocab(vocab.action_counts(events(spark, sf)), ACTION_VOCAB).drop("n")


def encoded_documents(spark: SparkSession, sf: str, pack: bool = False) -> DataFrame:
    """Symbols once per document, so that posts carry integers through the shuffles instead of text; with `pack` as
    `packed`, two bytes each."""
    symbols = hashed_symbols(F.col("text"), NUM_SYMBOLS)
    return texts(spark, sf).select("doc_id", packed(symbols).alias("packed") if pack else symbols.alias("syms"))


def encoded_posts(spark: SparkSession, sf: str, rows: DataFrame | None = None, pack: bool = False,
                  docs: DataFrame | None = None) -> DataFrame:
    """author_id, pos, post_id, syms (or `packed`), hour, minute, day, action_id, for all posts or for chosen rows of the
    timeline. `docs` are the encoded documents, if they are at hand."""
    docs = encoded_documents(spark, sf, pack) if docs is None else docs
    placed = with_doc(timeline(spark, sf) if rows is None else rows, docs, documents(spark, sf).count())
    named = history.lookup_action(placed, actions(spark, sf))
    return history.with_calendar(named).select(
        F.col("author").cast("bigint").alias("author_id"), "pos", "post_id", docs.columns[1], "hour", "minute", "day",
        F.col("action_id").cast("int").alias("action_id"))


def encoded_choice(spark: SparkSession, sf: str, chosen: DataFrame, sizes: bool = False) -> DataFrame:
    """Symbols, calendar and action id for chosen rows of the timeline (post_id, community, created_utc, ...), other
    columns kept. Posts are chosen on ids; only texts that some row needs are hashed, and travel once. With `sizes`, a
    post carries the number of its symbols, `n_syms`, and not the symbols."""
    text = F.col("text")
    symbols = F.size(words(text)).alias("n_syms") if sizes else hashed_symbols(text, NUM_SYMBOLS).alias("syms")
    placed = chosen.withColumn("doc_id", F.col("post_id") % documents(spark, sf).count())
    needed = placed.select("doc_id").distinct()
    docs = spread(documents(spark, sf).join(needed, "doc_id", "left_semi"), "doc_id").select(
        "doc_id", symbols)
    named = history.lookup_action(placed.join(docs, "doc_id"), actions(spark, sf))
    return history.with_calendar(named).withColumn("action_id", F.col("action_id").cast("int"))


def authors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("author_id")).distinct()


def thread_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as histories: author = conversation, order = turn, action = role."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("author_id"), F.col("turn").alias("pos"), F.col("role").alias("community"), "text",
        hashed_symbols(F.col("text"), NUM_SYMBOLS).alias("syms"))


def histories(spark: SparkSession, sf: str, features: list[str] | None = None) -> DataFrame:
    """Histories with all features, or with those named; what a query does not read is not nested."""
    posts = encoded_posts(spark, sf, pack=True)
    chosen = posts if features is None else posts.select("author_id", "pos", *features)
    return history.assemble_history(chosen, authors(spark, sf))


def history_parts(spark: SparkSession, sf: str) -> Iterator[DataFrame]:
    """The rows of `histories`, those of some authors at a time: only a part of the posts is in a shuffle at once. The
    texts are encoded once."""
    posts, texts_ = events(spark, sf), documents(spark, sf)
    n_posts = posts.count()
    n = min(n_posts // PART_POSTS, n_posts // (PART_TEXTS * max(1, texts_.count())))
    if n < 2:
        yield histories(spark, sf)
        return
    docs = settle(encoded_documents(spark, sf, pack=True))
    for i in range(n):
        here = lambda author: F.pmod(F.xxhash64(author.cast("string")), F.lit(n)) == i
        chosen = history.timeline(posts.where(here(F.col("author"))))
        yield history.assemble_history(encoded_posts(spark, sf, chosen, docs=docs), authors(spark, sf).where(here(F.col("author_id"))))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"))


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries and targets for linking: every vector is on exactly one side."""
    rows = embeddings(spark, sf)
    return rows.where(F.col("id") % 2 == 0), rows.where(F.col("id") % 2 == 1)


def mean_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries and targets for ranking: one mean vector per author and side."""
    rows = embeddings(spark, sf).withColumn("side", F.col("id") % 2)
    means = ranking.mean_embedding(rows, ["label", "side"]).select(F.col("label").alias("id"), "label", "side", "vec")
    return means.where("side = 0").drop("side"), means.where("side = 1").drop("side")


def batches(spark: SparkSession, sf: str, size: int = 512) -> DataFrame:
    return embeddings(spark, sf).withColumn("batch_id", F.floor(F.col("id") / size))


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Scored yes/no trials without pairs: alphabetic share of a labelled document against its quality label."""
    from inkprint.functions.text import alpha_fraction

    docs = documents(spark, sf).select("doc_id", F.round(alpha_fraction(F.col("text")), 6).alias("score"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("is_match"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "score", "is_match")


def source_posts(spark: SparkSession, sf: str, target_posts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """TF-IDF queries and targets: author = document source; runs of 20 documents fall on the two sides in turn, so
    every source is on both. Both have all their posts, unless `target_posts` keeps the first ones of a target's history.

    The history is then ordered on ids alone; only the chosen posts fetch their text."""
    side, label = F.floor(F.col("doc_id") / 20) % 2, F.substring("source", 4, 10).cast("bigint")
    queries = texts(spark, sf).where(side == 0).select("doc_id", "text", label.alias("label"))
    if target_posts is None:
        return queries, texts(spark, sf).where(side == 1).select("doc_id", "text", label.alias("label"))
    ids = documents(spark, sf).where(side == 1).select("doc_id", label.alias("label"))
    placed = history.timeline(ids, author="label", time="doc_id", tie="doc_id", bucket_seconds=4096)
    chosen = placed.where(F.col("pos") < target_posts).select("doc_id", "label")
    return queries, chosen.join(documents(spark, sf).select("doc_id", "text"), "doc_id")


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf: str, name: str, write) -> str:
    """Path of a derived file set, written once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        path = staging_path(spark, name)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


def subword_vocab(spark: SparkSession, sf: str) -> DataFrame:
    def write(path: str) -> None:
        subword.fit_subword_vocab(texts(spark, sf), "text", SUBWORD_SIZE).write.parquet(path)

    return spark.read.parquet(staged(spark, sf, "subword", write))

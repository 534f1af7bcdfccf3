"""TF-IDF over long (doc, term) tables, and its use as a linking baseline.

Texts of one author are never concatenated: term counts add up across posts, so a prolific author costs one row
per distinct term instead of one giant string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from inkprint.functions.text import STOP_WORDS, word_tokens
from inkprint.operators import pairs, verification
from inkprint.session import broadcast_if_small, settle

MAX_DOC_FRACTION = 0.9
MAX_TERMS = 20_000
MAX_BROADCAST_TERMS = 200_000


def tokens(docs: DataFrame, doc: str, body: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    exploded = docs.select(doc, F.explode(word_tokens(F.col(body))).alias("term"))
    return exploded.where(~F.col("term").isin(*stop_words)) if stop_words else exploded


def term_freq(token_rows: DataFrame, doc: str) -> DataFrame:
    return token_rows.groupBy(doc, "term").agg(F.count("*").alias("tf"))


def doc_freq(docs: DataFrame, n_docs: int, body: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Documents and occurrences per term, and the smoothed inverse document frequency ln((1+n)/(1+df)) + 1.

    A document is one row, so its distinct terms are known before any shuffle: each gives one `df` mark, each
    occurrence one `tf` mark, and only per-task sums per term are moved, not (document, term) counts."""
    found = docs.select(word_tokens(F.col(body)).alias("all"))
    once = F.transform(F.array_distinct("all"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t")))
    every = F.transform("all", lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t")))
    marks = found.select(F.inline(F.concat(once, every)))
    if stop_words:
        marks = marks.where(~F.col("term").isin(*stop_words))
    per_term = marks.groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("total_tf"))
    return per_term.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def vocabulary(per_term: DataFrame, n_docs: int, max_fraction: float = MAX_DOC_FRACTION,
               max_terms: int = MAX_TERMS) -> DataFrame:
    """The most frequent terms among those in at most `max_fraction` of the documents; ties by term."""
    best = per_term.where(F.col("df") <= max_fraction * n_docs).orderBy(F.desc("total_tf"), "term").limit(max_terms)
    # At most max_terms rows reach this window.
    ordered = Window.partitionBy(F.lit(0)).orderBy("term")
    return best.withColumn("term_id", (F.row_number().over(ordered) - 1).cast("int"))


def fit_tfidf(docs: DataFrame, body: str = "text", max_fraction: float = MAX_DOC_FRACTION,
              max_terms: int = MAX_TERMS) -> DataFrame:
    """The fitted model is a table: term, term_id, df, total_tf, idf; at most `max_terms` rows, settled for reuse."""
    n_docs = docs.count()
    return settle(vocabulary(doc_freq(docs, n_docs, body), n_docs, max_fraction, max_terms))


def tfidf_weights(frequencies: DataFrame, model: DataFrame, doc: str) -> DataFrame:
    """tf * idf, scaled to unit length per document. A document has at most as many rows as the vocabulary."""
    known = broadcast_if_small(model.select("term", "term_id", "idf"), MAX_BROADCAST_TERMS)
    weighted = frequencies.join(known, "term").withColumn(
        "raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", "term_id", (F.col("raw") / length).alias("w"))


def sparse_vectors(weights: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """(id, label, terms, weights) for the pair scorer; a document without known terms keeps empty arrays.
    The row size is bounded by the vocabulary."""
    entries = weights.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("e"))
    joined = labels.join(entries, doc, "left")
    return joined.select(
        F.col(doc).alias("id"), "label",
        F.coalesce(F.col("e.term_id"), F.array().cast("array<int>")).alias("terms"),
        F.coalesce(F.col("e.w"), F.array().cast("array<double>")).alias("weights"))


def author_vectors(posts: DataFrame, model: DataFrame, body: str = "text") -> DataFrame:
    """One TF-IDF vector per author over all their posts; `label` holds the author id."""
    weights = tfidf_weights(term_freq(tokens(posts, "label", body), "label"), model, "label")
    authors = posts.select(F.col("label").alias("doc")).distinct().withColumn("label", F.col("doc"))
    return sparse_vectors(weights.withColumnRenamed("label", "doc"), authors, "doc")


def first_posts(posts: DataFrame, count: int) -> DataFrame:
    """The first posts of every history, by position."""
    return posts.where(F.col("pos") < count)


def tfidf_linking(queries: DataFrame, targets: DataFrame, model: DataFrame) -> DataFrame:
    """Link authors by TF-IDF: the posts of every query against those of every target, linear kernel."""
    return verification.link_eval(
        settle(author_vectors(queries, model)), settle(author_vectors(targets, model)), metric="linear", decimals=pairs.SCORE_DECIMALS)

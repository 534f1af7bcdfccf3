"""Text predicates and functions, community vocabulary, corpus statistics, subwords."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from inkprint.functions import arrays, text
from inkprint.operators import subword, vocab
from inkprint.plans import inputs, sqlparts as q
from inkprint.plans.registry import query


@query("keep_comment", f"SELECT doc_id, {q.keep('text')} AS keep, round({q.alpha_fraction('text')}, 6) AS fraction FROM documents")
def keep_comment(spark, sf):
    return inputs.documents(spark, sf).select(
        "doc_id", text.keep_post(F.col("text")).alias("keep"), F.round(text.alpha_fraction(F.col("text")), 6).alias("fraction"))


@query("require_field", "SELECT doc_id, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def require_field(spark, sf):
    joined = inputs.documents(spark, sf).select("doc_id").join(
        inputs.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("bigint").alias("quality"))


@query("short_posts_preview", f"""
SELECT doc_id, text, {q.joined(q.syms('text'))} AS pieces FROM documents
WHERE len({q.words('text')}) < 15 ORDER BY doc_id LIMIT 6""")
def short_posts_preview(spark, sf):
    found = vocab.short_posts(inputs.documents(spark, sf), "doc_id", body="text")
    return found.select("doc_id", "text", arrays.joined(text.hashed_symbols(F.col("text"))).alias("pieces"))


@query("clean_newlines", "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS clean_md5 FROM documents")
def clean_newlines(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", F.md5(text.clean_newlines(F.col("text"))).alias("clean_md5"))


@query("strip_trailing", """
SELECT doc_id, length(rtrim(text || chr(9) || ' ' || chr(10), ' ' || chr(9) || chr(10) || chr(13))) AS n,
       md5(rtrim(text || chr(9) || ' ' || chr(10), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM documents""")
def strip_trailing(spark, sf):
    stripped = text.strip_trailing(F.concat(F.col("text"), F.lit("\t \n")))
    return inputs.documents(spark, sf).select("doc_id", F.length(stripped).cast("bigint").alias("n"), F.md5(stripped).alias("text_md5"))


@query("word_count", f"SELECT doc_id, len({q.words('text')}) AS n_words FROM documents")
def word_count(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query("action_counts", f"SELECT source AS action, count(*) AS n FROM documents WHERE {q.keep('text')} GROUP BY source")
def action_counts(spark, sf):
    return vocab.action_counts(vocab.kept_posts(inputs.documents(spark, sf), "text"), "source")


@query("top_actions", f"""
SELECT source AS action, count(*) AS n FROM documents WHERE {q.keep('text')} GROUP BY source
ORDER BY n DESC, action LIMIT 5""")
def top_actions(spark, sf):
    return vocab.top_actions(action_counts(spark, sf))


@query("action_vocab", f"""
WITH c AS (SELECT source AS action, count(*) AS n FROM documents WHERE {q.keep('text')} GROUP BY source),
r AS (SELECT action, row_number() OVER (ORDER BY n DESC, action) - 1 AS action_id, n FROM c)
SELECT * FROM r WHERE action_id < 15 UNION ALL SELECT '<unk>', 15, NULL""")
def action_vocab(spark, sf):
    return vocab.action_vocab(action_counts(spark, sf), 16)


@query("corpus_stats", f"SELECT count(*) AS n_total, count(*) FILTER ({q.keep('text')}) AS n_kept FROM documents")
def corpus_stats(spark, sf):
    return vocab.corpus_stats(inputs.documents(spark, sf), "text")


@query("sample_sentences", f"""
SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY {q.hash32('sentences', 'doc_id')}, doc_id LIMIT 1000000""")
def sample_sentences(spark, sf):
    """The reference's sample size, 1,000,000."""
    return vocab.sample_sentences(inputs.documents(spark, sf), "doc_id", 1_000_000).select(
        "doc_id", F.md5("text").alias("text_md5"))


@query("shuffle_records", f"""
SELECT doc_id, {q.hash32('shuffle', 'doc_id')} AS draw FROM documents ORDER BY draw, doc_id""")
def shuffle_records(spark, sf):
    from inkprint.operators.episodes import shuffle_records as shuffle

    return shuffle(inputs.documents(spark, sf).select("doc_id"), "shuffle", "doc_id")


@query("word_tokens", f"""
WITH {q.STOP},
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{q.TOKEN}')) AS term FROM documents)
SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN (SELECT term FROM stop) GROUP BY doc_id, term""")
def word_tokens(spark, sf):
    from inkprint.operators import tfidf

    return tfidf.tokens(inputs.texts(spark, sf), "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("fit_subword_vocab", """
SELECT piece, piece_id FROM (VALUES ('<pad>', 0::BIGINT), ('</s>', 1), ('<unk>', 2)) t(piece, piece_id)
UNION ALL
SELECT CASE i WHEN 0 THEN 'all characters' WHEN 1 THEN 'ids are dense' WHEN 2 THEN 'size within bound'
       ELSE 'half the pieces of single characters' END, CASE WHEN i < 3 OR n > 0 THEN 1 ELSE 0 END
FROM (VALUES (0), (1), (2), (3)) v(i), (SELECT count(*) AS n FROM documents)""")
def fit_subword_vocab(spark, sf):
    """The fitted vocabulary is checked, not listed: reserved ids, every character of the text, dense ids, size, and that
    the texts need less than half as many pieces as characters and words."""
    fitted = inputs.subword_vocab(spark, sf)
    reserved = fitted.where(F.col("piece_id") < 3).select("piece", F.col("piece_id").cast("bigint").alias("piece_id"))
    letters = inputs.documents(spark, sf).select(F.explode(F.split("text", "")).alias("piece")).where(
        ~F.col("piece").rlike(f"^[{text.WHITESPACE_CLASS}]*$")).distinct()
    missing = letters.join(fitted, "piece", "left_anti").agg((F.count("*") == 0).cast("bigint").alias("piece_id"))
    shape = fitted.agg(
        ((F.max("piece_id") == F.count("*") - 1) & (F.count_distinct("piece_id") == F.count("*"))).cast("bigint").alias("dense"),
        (F.count("*") <= inputs.SUBWORD_SIZE).cast("bigint").alias("bound"))
    letters_in = F.aggregate(text.words(F.col("text")), F.lit(0), lambda n, w: n + F.length(w) + 1)
    encoded = subword.encode_posts(inputs.texts(spark, sf), fitted, "text").select(
        F.size("syms").alias("n"), letters_in.alias("c"))
    saved = encoded.agg((F.sum("n") * 2 < F.sum("c")).cast("bigint").alias("piece_id"))
    return reserved.unionByName(missing.withColumn("piece", F.lit("all characters"))).unionByName(
        shape.select(F.lit("ids are dense").alias("piece"), F.col("dense").alias("piece_id"))).unionByName(
        shape.select(F.lit("size within bound").alias("piece"), F.col("bound").alias("piece_id"))).unionByName(
        saved.select(F.lit("half the pieces of single characters").alias("piece"), "piece_id"))


def marked_pieces(spark, sf):
    """Encoded documents with the number of pieces that start a word."""
    fitted = inputs.subword_vocab(spark, sf)
    rows = fitted.where(F.col("piece").startswith(subword.MARK)).select("piece_id").collect()
    starts = spark.sparkContext.broadcast(frozenset(r["piece_id"] for r in rows))

    @F.pandas_udf("bigint")
    def marked(syms: pd.Series) -> pd.Series:
        return syms.map(lambda ids: sum(i in starts.value for i in ids))

    encoded = subword.encode_posts(inputs.texts(spark, sf), fitted, "text")
    return encoded.select("doc_id", "syms", marked("syms").alias("n_words"))


@query("encode_symbols", f"SELECT doc_id, len({q.words('text')}) AS n_words, true AS covers FROM documents")
def encode_symbols(spark, sf):
    """Every word starts with exactly one marked piece, and a word has at least one piece."""
    return marked_pieces(spark, sf).select("doc_id", "n_words", (F.size("syms") >= F.col("n_words")).alias("covers"))


@query("encode_posts", f"""
WITH {q.EV}
SELECT post_id, author, len({q.words('text')}) AS n_words
FROM ev JOIN documents ON doc_id = post_id % (SELECT count(*) FROM documents)""")
def encode_posts(spark, sf):
    """Posts with the symbols of their text: each distinct text is encoded once, and integers travel, not text."""
    docs = marked_pieces(spark, sf)
    posts = inputs.with_doc(inputs.events(spark, sf), docs, inputs.documents(spark, sf).count())
    return posts.select("post_id", "author", "n_words")


@query("decode_symbols", f"SELECT doc_id, md5(array_to_string({q.words('text')}, ' ')) AS text_md5 FROM documents")
def decode_symbols(spark, sf):
    """Decoding the encoded text gives the words back, single-spaced."""
    fitted = inputs.subword_vocab(spark, sf)
    encoded = subword.encode_posts(inputs.texts(spark, sf).select("doc_id", "text"), fitted, "text")
    return subword.decode_posts(encoded, fitted, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))

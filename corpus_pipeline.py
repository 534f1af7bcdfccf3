"""A training corpus from raw documents: language, near duplicates, repeated passages, source mix, packed sequences."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkprint.llm import language, minhash_dedup, mixing, packing, suffix_dedup  # noqa: E402
from inkprint.llm.queries import tokenizer_file  # noqa: E402
from inkprint.session import staging_path  # noqa: E402
from inkprint.ship import ship  # noqa: E402

LEAST_SCORE = 0.5


def _sized(docs: DataFrame) -> DataFrame:
    """`n_chars`, where the table has it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table's own labels, as far as their text tells. Texts without a letter
    go, and texts that leave more than half of the probability to other languages. Without any label nothing goes."""
    ship(spark)
    model = language.fit(docs, tokenizer_file("piece_bpe_32k.model"))
    if not model.languages:
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = language.predict(docs.toDF(*names), model, names, names[docs.columns.index("text")])
    kept = scored.where((F.col("lang_pred") != language.UNKNOWN_LANGUAGE) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Equal rows are one document; documents
    without an id stay."""
    ship(spark)
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.where("doc_id is null")).select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 50 bytes and more that a document with a smaller id has. Characters are
    removed whole. A null text stays null."""
    ship(spark)
    others = [c for c in docs.columns if c != "text"]
    has_text = "_".join(docs.columns) + "_"  # no column's name
    marked = docs.withColumn(has_text, F.col("text").isNotNull())
    found = suffix_dedup.remove_repeats(marked, window=50, keep=[*others, has_text], whole_characters=True)
    text = F.when(F.col(f"c{len(others)}"), F.col("kept").cast("string"))
    place = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": text}
    return _sized(found.select(*[place[c].alias(c) for c in docs.columns]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document and epoch, its text cut to the words taken."""
    ship(spark)
    return _sized(mixing.mixed_documents(docs, mixing.mix(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 token ids, with the ids."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("minmax_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the language model or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = staging_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs

"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.llm.common import ASCII_WORD
from inkprint.operators.prefix import running_sums
from inkprint.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 64
POINTS = 1 << 31
GOLDEN = 1327217885  # 2^31 divided by the golden ratio, to the nearest odd number
CELLS = 4096
CHUNK = 4096
ROWS_PER_BUCKET = 50_000


@dataclass
class Mixture:
    """`docs`: one row per document with row (its number within the source's order), doc_id, source, size, source_size,
    target, first_word. `stream`: the mix in order of slot: slot, source, epoch, block, first_word and doc_id of a
    document, and the words of it that the slot takes, low .. high (end excluded)."""

    docs: DataFrame
    stream: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ASCII_WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> target. Sources in code point order, null last, weigh `weights`, repeating, and share
    `share` times all words. None gets more than `most` times its words; what is above is shared again by weight.

    In the order of (limit / weight) the sources at their limit come first, so one level settles all others.
    """
    whole = Window.partitionBy(F.lit(0))  # one row per source
    turn = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    order = whole.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(whole).cast("double")
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    reached = F.when(F.col("level") <= F.col("limit") / F.col("w"), F.col("level"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", F.first(reached, ignorenulls=True).over(every))
    level = F.coalesce(F.col("level") * F.col("w"), F.col("limit"))
    return rows.select("source", "source_size", F.least(level, F.col("limit")).alias("target"))


def schedule(quotas: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """source_no, quota -> slot, source_no, rank: slot i takes the golden-ratio point i; the cumulative quotas divide
    the unit interval among the sources. A source's slots are ranked; each has exactly its quota in the end.

    Points meet sources through a table of equal cells of the interval, not by comparing each with all sources.
    """
    spark = quotas.sparkSession
    upto = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    ends = quotas.withColumn("end", F.sum("quota").over(upto)).withColumn("all", F.sum("quota").over(whole))
    slots = ends.agg(F.max("all")).first()[0] or 0

    def bound(cumulative: Column) -> Column:
        return F.floor(cumulative.cast("double") * float(POINTS) / F.col("all").cast("double")).cast("bigint")

    width = POINTS // CELLS
    ranges = ends.where("quota > 0").select(
        "source_no", "quota", bound(F.col("end") - F.col("quota")).alias("low"), bound(F.col("end")).alias("high"))
    cells = ranges.where("high > low").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") % POINTS * GOLDEN % POINTS).alias("point")).withColumn(
            "cell", F.floor(F.col("point") / width))
    drawn = points.join(cells, "cell").where("point >= low and point < high").select(
        "slot", "source_no", F.floor(F.col("slot") / chunk).alias("chunk"))
    ranked = running_sums(drawn, [F.col("slot")], {"rank": F.lit(1)}, ["source_no"], "chunk").select(
        "slot", "source_no", (F.col("rank") - 1).alias("rank"))
    ranked = ranked.join(quotas, "source_no").where("rank < quota").select("slot", "source_no", "rank")
    # The sequence may leave a source a few slots short; they follow at the end.
    reached = ranked.groupBy("source_no").agg(F.count("*").alias("n"))
    short = quotas.join(reached, "source_no", "left").select("source_no", "quota", F.coalesce("n", F.lit(0)).alias("n"))
    rest = short.where("n < quota").select("source_no", F.explode(F.sequence("n", F.col("quota") - 1)).alias("rank"))
    return ranked.unionByName(rest.select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
        block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        rows_per_bucket: int = ROWS_PER_BUCKET) -> Mixture:
    """Mix all documents to the targets of `targets`.

    Each source's documents are shuffled by the md5 of their id and laid end to end; blocks of `block_words` words cut
    that line. `schedule` deals one block per slot: the k-th slot of a source takes its block k, starting over after
    the last, so a source is used evenly and a document at most ceil(`most`) times. Quotas are whole blocks: a source's
    words come within half a block of its target. A hot source is laid out and ranked in buckets, like any other.

    Defined cases: a null or empty text has 0 words and nothing is taken of it; a null source is a source of its own; a
    null id sorts as the empty string; rows that repeat an id are separate documents; equal rows are interchangeable;
    an empty table gives no rows; other columns are ignored. The same rows give the same mix in every run.
    """
    sized = settle(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source; its number stands for the name, null included.
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    of_source = settle(targets(sources, weights, share, most).withColumn("source_no", number))
    blocks = F.ceil(F.col("source_size") / block_words)
    full = F.floor(F.col("target") / F.col("source_size"))
    part = F.round((F.col("target") - full * F.col("source_size")) / block_words)
    quota = F.when(F.col("source_size") > 0, F.least(full * blocks + F.least(part, blocks), blocks * int(most)))
    quotas = of_source.select("source_no", F.coalesce(quota, F.lit(0)).cast("bigint").alias("quota"))

    rows = sized.count()
    buckets = max(1, min(1 << 20, rows // rows_per_bucket + 1))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = sized.join(of_source, sized.source.eqNullSafe(of_source.source)).select(
        "doc_id", sized.source, "size", "text_hash", "source_no", "source_size", "target", order.alias("order"))
    placed = placed.withColumn("bucket", F.floor(
        F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)).cast("bigint"))
    by = [F.col("order"), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    laid = running_sums(placed, by, {"end": F.col("size"), "row": F.lit(1)}, ["source_no"], "bucket").select(
        "source_no", "row", "doc_id", "source", "size", "source_size", "target", "text_hash",
        (F.col("end") - F.col("size")).alias("first_word"))
    laid = settle(laid)

    last = F.col("first_word") + F.col("size") - 1
    pieces = laid.where("size > 0").select(
        "source_no", "source", "doc_id", "first_word", "size",
        F.explode(F.sequence(F.floor(F.col("first_word") / block_words), F.floor(last / block_words))).alias("block"))
    pieces = pieces.select(
        "source_no", "source", "block", "doc_id", "first_word",
        F.greatest(F.col("block") * block_words - F.col("first_word"), F.lit(0)).alias("low"),
        F.least((F.col("block") + 1) * block_words - F.col("first_word"), F.col("size")).alias("high"))
    per_source = of_source.select("source_no", blocks.cast("bigint").alias("blocks"))
    slots = schedule(quotas).join(per_source, "source_no").select(
        "slot", "source_no", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"),
        (F.col("rank") % F.col("blocks")).alias("block"))
    stream = slots.join(pieces, ["source_no", "block"]).select(
        "slot", "source_no", "source", "epoch", "block", "doc_id", "first_word", "low", "high")
    return Mixture(laid, stream)


def taken(mixture: Mixture) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document, repeats counted."""
    used = mixture.stream.groupBy("source_no", "first_word").agg(F.sum(F.col("high") - F.col("low")).alias("used"))
    # A document with words is alone at its first word; one without shares it, and gets 0.
    joined = mixture.docs.join(used, ["source_no", "first_word"], "left")
    got = F.when(F.col("size") > 0, F.coalesce("used", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return joined.select("doc_id", "size", "source_size", "target", got.alias("taken"))


def mixed_documents(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The rows of `docs` as the mix takes them: one row per document and epoch, with its text cut to the words taken."""
    parts = mixture.stream.groupBy("source_no", "first_word", "epoch").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"))
    copy = F.row_number().over(Window.partitionBy("_id", "_hash", "_source").orderBy("_row"))
    chosen = mixture.docs.where("size > 0").join(parts, ["source_no", "first_word"]).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"),
        F.col("row").alias("_row"), F.col("size").alias("_size"), "_low", "_high")
    # Equal rows are told apart by a number, which may be dealt in any order.
    chosen = chosen.withColumn("_copy", F.dense_rank().over(
        Window.partitionBy("_id", "_hash", "_source").orderBy("_row")))
    rows = docs.select("*", F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_hash"),
                       F.col(source_col).cast("string").alias("_source"), F.lit(0).alias("_row")).withColumn("_copy", copy)
    match = [rows[c].eqNullSafe(chosen[c]) for c in ("_id", "_hash", "_source", "_copy")]
    joined = rows.join(chosen, match)
    tokens = F.split(text_col, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col(text_col).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    text = F.array_join(F.slice(tokens, F.col("_low").cast("int") + 1 + lead, (F.col("_high") - F.col("_low")).cast("int")),
                        "")
    whole = (F.col("_low") == 0) & (F.col("_high") == F.col("_size"))
    cut = F.when(whole, F.col(text_col)).otherwise(text)
    return joined.select(*[cut.alias(c) if c == text_col else rows[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM s0),
s2 AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS lim FROM s1),
s3 AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(lim) OVER (ORDER BY lim / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY lim / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (
  SELECT *, (SELECT arg_min(level, level_order) FROM (
     SELECT level, row_number() OVER (ORDER BY lim / w, no) AS level_order, lim, w FROM s3) WHERE level <= lim / w) AS top
  FROM s3),
s5 AS (
  SELECT no, source, source_size, least(coalesce(top * w, lim), lim) AS target,
         CAST(ceil(source_size / 64.0::DOUBLE) AS BIGINT) AS blocks FROM s4),
s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(
     floor(target / source_size) * blocks
     + least(round((target - floor(target / source_size) * source_size) / 64.0::DOUBLE), blocks), blocks * 2) AS BIGINT)
     ELSE 0 END AS quota FROM s5),
p AS (
  SELECT d.*, s6.no, s6.source_size, s6.target, s6.blocks, s6.quota,
         CAST(sum(d.size) OVER (PARTITION BY s6.no ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT)
           - d.size AS first_word
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
e AS (
  SELECT *, quota // greatest(blocks, 1) AS full_epochs, (quota % greatest(blocks, 1)) * 64 AS part FROM p)
SELECT doc_id, size, source_size, target,
       CAST(full_epochs * size + greatest(0, least(first_word + size, part) - first_word) AS BIGINT) AS taken
FROM e
"""

"""Vector functions, scoring, ranking and verification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions import vectors
from inkprint.operators import pairs, ranking, verification
from inkprint.plans import inputs, sqlparts as q
from inkprint.plans.registry import query
from inkprint.sources.writers import metric_lines

NEXT = q.EMB + """,
nx AS (SELECT a.id, a.vec AS a, b.vec AS b, list_dot_product(a.vec, b.vec) AS dot,
              sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)) AS sizes
       FROM emb a JOIN emb b ON b.id = a.id + 1)"""


def neighbours(spark, sf):
    """Every vector with the next one: pairs that sit on one row, without a pair explosion."""
    rows = inputs.embeddings(spark, sf).select("id", "vec")
    after = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    return rows.withColumnRenamed("vec", "a").join(after, "id")


def _pair_query(name, expression, sql):
    def run(spark, sf):
        value = F.round(expression(F.col("a"), F.col("b")), 6) + 0.0
        return neighbours(spark, sf).select("id", value.alias("value"))

    query(name, f"WITH {NEXT} SELECT id, round({sql}, 6) + 0.0::DOUBLE AS value FROM nx")(run)


_pair_query("dot_score", vectors.dot_score, "dot")
_pair_query("cosine_distance", vectors.cosine_distance, "1 - list_cosine_similarity(a, b)")
_pair_query("angular_score", vectors.angular_score, "1 - acos(greatest(-1, least(1, dot))) / pi()")


@query("metric_distance", f"""
WITH {NEXT}
SELECT id, round(list_distance(a, b), 6) AS euclidean,
       round(list_sum(list_transform(a, lambda x, i: abs(x - b[i]))), 6) AS manhattan,
       round(list_max(list_transform(a, lambda x, i: abs(x - b[i]))), 6) AS chebyshev FROM nx""")
def metric_distance(spark, sf):
    return neighbours(spark, sf).select("id", *[
        F.round(vectors.metric_distance(m, F.col("a"), F.col("b")), 6).alias(m)
        for m in ("euclidean", "manhattan", "chebyshev")])


@query("l2_normalize", f"""
WITH {q.EMB}
SELECT id, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) + 0.0::DOUBLE AS first,
       round(list_sum(vec) / sqrt(list_dot_product(vec, vec)), 6) + 0.0::DOUBLE AS total FROM emb""")
def l2_normalize(spark, sf):
    unit = inputs.embeddings(spark, sf).select("id", vectors.l2_normalize(F.col("vec")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    return unit.select("id", (F.round(F.element_at("v", 1), 6) + 0.0).alias("first"), (F.round(total, 6) + 0.0).alias("total"))


@query("mean_embedding", f"WITH {q.MEANS} SELECT label, side, i - 1 AS dim, round(x, 6) + 0.0::DOUBLE AS value FROM dims")
def mean_embedding(spark, sf):
    rows = inputs.embeddings(spark, sf).withColumn("side", F.col("id") % 2)
    means = ranking.mean_embedding(rows, ["label", "side"])
    return means.select("label", "side", F.posexplode("vec").alias("dim", "x")).select(
        "label", "side", F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("value"))


RANKS = f"""{q.MEANS},
d AS (SELECT a.label AS qid, b.label AS tid, round(1 - list_cosine_similarity(a.vec, b.vec), 12) AS d
      FROM means a JOIN means b ON a.side = 0 AND b.side = 1),
r AS (SELECT qid, tid, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rank FROM d),
ranks AS (SELECT qid AS q, rank FROM r WHERE qid = tid)"""
RANK_METRICS = """
SELECT round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, min(rank) AS min_rank,
       max(rank) AS max_rank, median(rank)::DOUBLE AS median_rank, """ + ", ".join(
    f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_{k}" for k in ranking.RECALL_AT) + """,
       count(*) AS num_queries"""


@query("true_rank", f"WITH {RANKS} SELECT q, rank FROM ranks")
def true_rank(spark, sf):
    return ranking.true_rank(*inputs.mean_sides(spark, sf)).select("q", "rank")


def rounded(row):
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


# Every vector of one side against the mean vectors of the other.
VECTOR_RANKS = f"""{q.MEANS},
d AS (SELECT e.id AS qid, e.label AS qlabel, m.label AS tid, round(1 - list_cosine_similarity(e.vec, m.vec), 12) AS d
      FROM emb e JOIN means m ON e.id % 2 = 0 AND m.side = 1),
r AS (SELECT qid, qlabel, tid, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rank FROM d),
ranks AS (SELECT qid AS q, rank FROM r WHERE qlabel = tid)"""


@query("rank_metrics", f"WITH {VECTOR_RANKS} {RANK_METRICS} FROM ranks")
def rank_metrics(spark, sf):
    """Single vectors as queries: the number of ranks grows with the table."""
    queries, _ = inputs.sides(spark, sf)
    _, targets = inputs.mean_sides(spark, sf)
    return rounded(ranking.rank_metrics(ranking.true_rank(queries, targets)))


@query("rank_eval", f"""
WITH {RANKS} {RANK_METRICS}, (SELECT count(*) FROM means WHERE side = 1) AS num_targets FROM ranks""")
def rank_eval(spark, sf):
    return rounded(ranking.rank_eval(*inputs.mean_sides(spark, sf)))


PRECOMPUTED = """sc AS (
  SELECT doc_id AS q, t, distance, CASE WHEN t = doc_id % 5 THEN 1 ELSE 0 END AS is_match
  FROM (SELECT doc_id, unnest(range(5)) AS t, n_chars FROM documents) d,
  LATERAL (SELECT abs(n_chars % 1009 - t * 200)::DOUBLE AS distance))"""


@query("precomputed_scores", f"""
WITH {PRECOMPUTED}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, t) AS rank FROM sc)
SELECT q, rank FROM r WHERE is_match = 1""")
def precomputed_scores(spark, sf):
    """Ranks from a distance table that is given: here each document against five length profiles."""
    rows = inputs.documents(spark, sf).select(
        F.col("doc_id").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t"), "n_chars")
    scores = rows.select(
        "q", "t", F.abs(F.col("n_chars") % 1009 - F.col("t") * 200).cast("double").alias("distance"),
        (F.col("t") == F.col("q") % 5).cast("int").alias("is_match"))
    return ranking.rank_from_scores(scores)


SIDES = f"""{q.EMB},
sc AS (SELECT a.id AS q, b.id AS t, a.label = b.label AS same, b.label AS t_label,
              1 - list_cosine_similarity(a.vec, b.vec) AS d
       FROM emb a JOIN emb b ON a.id % 2 = 0 AND b.id % 2 = 1)"""


@query("score_pairs", f"""
WITH {SIDES}
SELECT q, count(*) AS n_targets, count(*) FILTER (same) AS n_same_author, round(sum(d), 4) AS score_sum,
       round(min(d), 6) AS score_min, round(max(d), 6) AS score_max FROM sc GROUP BY q""")
def score_pairs(spark, sf):
    """Every query scored against every target; the pairs are summed up inside the cells and never become rows."""
    stats = pairs.score_statistics(*inputs.sides(spark, sf), decimals=12)
    return stats.select("q", "n_targets", "n_same_author", F.round("score_sum", 4).alias("score_sum"),
                        F.round("score_min", 6).alias("score_min"), F.round("score_max", 6).alias("score_max"))


@query("nearest_targets", f"""
WITH {SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), t) AS rank FROM sc)
SELECT q, t, t_label, rank, round(d, 6) AS distance FROM r WHERE rank <= 10""")
def nearest_targets(spark, sf):
    found = pairs.nearest_targets(*inputs.sides(spark, sf), k=10)
    return found.select("q", "t", "t_label", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


LINK_COUNTS = f"""{q.EMB},
counts AS (
  SELECT list_dot_product(a.vec, b.vec)
           / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) AS score,
         count(*) FILTER (a.label = b.label) AS pos, count(*) FILTER (a.label <> b.label) AS neg
  FROM emb a JOIN emb b ON a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1)"""


@query("score_distribution", f"""
WITH {SIDES} SELECT round(-d, 3) + 0.0::DOUBLE AS score, count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg
FROM sc GROUP BY 1""")
def score_distribution(spark, sf):
    return pairs.score_distribution(*inputs.sides(spark, sf), decimals=3)


@query("link_eval", f"WITH {LINK_COUNTS}, {q.CURVE} {q.LINK_METRICS}")
def link_eval(spark, sf):
    return rounded(verification.link_eval(*inputs.sides(spark, sf), places=6))


@query("linking_metrics", f"WITH {q.TRIAL_COUNTS}, {q.CURVE} {q.LINK_METRICS}")
def linking_metrics(spark, sf):
    return rounded(verification.metrics_from_counts(verification.score_counts(inputs.trials(spark, sf))))


def curve(spark, sf):
    return verification.roc_curve(verification.score_counts(inputs.trials(spark, sf)))


@query("auc_roc", f"""
WITH {q.TRIALS}
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END), 6) AS auc
FROM tr p JOIN tr n ON p.is_match = 1 AND n.is_match = 0""")
def auc_roc(spark, sf):
    return curve(spark, sf).agg(F.round(verification.auc_column(), 6).alias("auc"))


@query("roc_points", f"""
WITH {q.TRIAL_COUNTS}, {q.CURVE}
SELECT score, true_pos::BIGINT AS true_pos, false_pos::BIGINT AS false_pos, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve""")
def roc_points(spark, sf):
    return verification.roc_points(curve(spark, sf)).select(
        "score", "true_pos", "false_pos", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("roc_drop_collinear", f"WITH {q.TRIAL_COUNTS}, {q.CURVE} SELECT score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve WHERE kept")
def roc_drop_collinear(spark, sf):
    return verification.roc_points(curve(spark, sf)).where("kept").select(
        "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("eer", f"""
WITH {q.TRIAL_COUNTS}, {q.CURVE}
SELECT (SELECT round(arg_min(fpr, (abs((1 - tpr) - fpr), -score)), 6) FROM curve WHERE kept) AS eer,
       (SELECT round(arg_min(fpr, (abs((1 - tpr) - fpr), -score)), 6) FROM curve) AS eer_all_points""")
def eer(spark, sf):
    return curve(spark, sf).agg(
        F.round(verification.eer_column(), 6).alias("eer"),
        F.round(verification.eer_column(drop_collinear=False), 6).alias("eer_all_points"))


@query("eer_v2", f"""
WITH {q.TRIAL_COUNTS}, {q.CURVE}
SELECT round(max(f0 + (fpr - f0) * (1 - f0 - t0) / ((fpr - f0) + (tpr - t0))), 6) AS eer_v2 FROM curve
WHERE 1 - f0 - t0 > 0 AND 1 - fpr - tpr <= 0""")
def eer_v2(spark, sf):
    return curve(spark, sf).agg(F.round(verification.eer_v2_column(), 6).alias("eer_v2"))


RATES = f"""{q.TRIALS},
er AS (
  SELECT id, score, is_match, sum(is_match) OVER w::BIGINT AS cum_pos, sum(1 - is_match) OVER w::BIGINT AS cum_neg,
         sum(is_match) OVER ()::BIGINT AS np, sum(1 - is_match) OVER ()::BIGINT AS nn
  FROM tr WINDOW w AS (ORDER BY score, id ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT *, cum_pos / np AS fnr, 1 - cum_neg / nn AS fpr FROM er)"""


@query("error_rates", f"""
WITH {RATES} SELECT id, score, cum_pos, cum_neg, round(fnr, 6) AS fnr, round(fpr, 6) + 0.0::DOUBLE AS fpr FROM rates""")
def error_rates(spark, sf):
    rates = verification.error_rates(inputs.trials(spark, sf), ["id"])
    return rates.select("id", "score", "cum_pos", "cum_neg", F.round("fnr", 6).alias("fnr"), (F.round("fpr", 6) + 0.0).alias("fpr"))


@query("min_dcf", f"""
WITH {RATES}, c AS (SELECT *, fnr * 0.01::DOUBLE + fpr * 0.99::DOUBLE AS cost FROM rates)
SELECT round(min(cost) / 0.01::DOUBLE, 6) AS min_dcf, arg_min(score, (cost, score, id)) AS threshold FROM c""")
def min_dcf(spark, sf):
    rates = verification.error_rates(inputs.trials(spark, sf), ["id"])
    return rounded(verification.min_dcf(rates, ["id"]))


@query("trial_metrics", f"""
WITH {q.TRIAL_COUNTS}, {q.CURVE}, lm AS ({q.LINK_METRICS}), {RATES.replace(q.TRIALS + ",", "", 1)},
c AS (SELECT *, fnr * 0.01::DOUBLE + fpr * 0.99::DOUBLE AS cost FROM rates)
SELECT (SELECT auc_roc FROM lm) AS auc_roc, (SELECT eer FROM lm) AS eer, (SELECT eer_v2 FROM lm) AS eer_v2,
       round(min(cost) / 0.01::DOUBLE, 6) AS min_dcf, round(arg_min(score, (cost, score, id)), 6) AS threshold FROM c""")
def trial_metrics(spark, sf):
    """All metrics of a given score table, the cost over its items."""
    return rounded(verification.trial_metrics(inputs.trials(spark, sf), ["id"]))


@query("score_sort", f"WITH {q.TRIALS} SELECT id, score, row_number() OVER (ORDER BY score, id) - 1 AS place FROM tr")
def score_sort(spark, sf):
    """Ascending stable order of all scores: the place of each trial."""
    from inkprint.operators.prefix import running_sums, with_range_bucket

    placed = with_range_bucket(inputs.trials(spark, sf), ["score", "id"], spark.sparkContext.defaultParallelism)
    placed = running_sums(placed, [F.col("score"), F.col("id")], {"place": F.lit(1)})
    return placed.select("id", "score", (F.col("place") - 1).alias("place"))


def merged_metrics(spark, sf):
    """Ranking and linking metrics as (name, value) rows; linking wins on equal names."""
    link = metric_lines(link_eval(spark, sf)).withColumn("first", F.lit(0))
    rank = metric_lines(rank_eval(spark, sf)).withColumn("first", F.lit(1))
    both = link.unionByName(rank)
    return both.groupBy("name").agg(F.min_by("value", "first").alias("value"))


_RANK_NAMES = ["mrr", "mean_rank", "min_rank", "max_rank", "median_rank",
               *[f"recall_at_{k}" for k in ranking.RECALL_AT], "num_queries", "num_targets"]
_LINK_NAMES = ["auc_roc", "eer", "eer_v2", "min_dcf"]
MERGED = f"""
WITH {LINK_COUNTS}, {q.CURVE}, {RANKS.replace(q.EMB + ',', '', 1)},
lm AS ({q.LINK_METRICS}), rm AS ({RANK_METRICS}, (SELECT count(*) FROM means WHERE side = 1) AS num_targets FROM ranks)
""" + " UNION ALL ".join(
    [f"SELECT '{n}' AS name, {n}::DOUBLE AS value FROM lm" for n in _LINK_NAMES]
    + [f"SELECT '{n}', {n}::DOUBLE FROM rm" for n in _RANK_NAMES])

query("metrics_union", MERGED)(merged_metrics)


@query("metrics_sorted", MERGED)
def metrics_sorted(spark, sf):
    return merged_metrics(spark, sf).orderBy("name")

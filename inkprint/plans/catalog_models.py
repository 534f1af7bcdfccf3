"""TF-IDF, batch mining, episode features."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions.text import words
from inkprint.operators import episodes, features, history, mining, pairs, tfidf
from inkprint.plans import inputs, sqlparts as q
from inkprint.plans.catalog_episodes import PAIRS, counts, draws, pair_samples
from inkprint.plans.catalog_eval import rounded
from inkprint.plans.registry import query
from inkprint.session import settle, spread

DOCS = "docs AS (SELECT doc_id AS doc, text FROM documents)"


@query("term_freq", f"WITH {DOCS}, {q.TFIDF} SELECT doc AS doc_id, term, tf FROM tf")
def term_freq(spark, sf):
    return tfidf.term_freq(tfidf.tokens(inputs.texts(spark, sf), "doc_id"), "doc_id")


@query("doc_freq", f"WITH {DOCS}, {q.TFIDF} SELECT term, df, total_tf, round(idf, 6) AS idf FROM terms")
def doc_freq(spark, sf):
    docs = inputs.texts(spark, sf)
    found = tfidf.doc_freq(docs, docs.count())
    return found.select("term", "df", "total_tf", F.round("idf", 6).alias("idf"))


@query("vocab_topn", f"WITH {DOCS}, {q.TFIDF} SELECT term, term_id, df, total_tf FROM model")
def vocab_topn(spark, sf):
    """The reference's vocabulary size, 20,000, after the document-frequency cut."""
    model = tfidf.fit_tfidf(inputs.texts(spark, sf))
    return model.select("term", F.col("term_id").cast("bigint").alias("term_id"), "df", "total_tf")


@query("fit_tfidf", f"WITH {DOCS}, {q.TFIDF} SELECT term, term_id, round(idf, 6) AS idf FROM model")
def fit_tfidf(spark, sf):
    return tfidf.fit_tfidf(inputs.texts(spark, sf)).select(
        "term", F.col("term_id").cast("bigint").alias("term_id"), F.round("idf", 6).alias("idf"))


@query("tfidf_weights", f"""
WITH {DOCS}, {q.TFIDF}, r AS (SELECT doc, term, tf * idf AS raw FROM tf JOIN model USING (term))
SELECT doc AS doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)), 6) AS w FROM r""")
def tfidf_weights(spark, sf):
    docs = inputs.texts(spark, sf)
    frequencies = tfidf.term_freq(tfidf.tokens(docs, "doc_id"), "doc_id")
    weights = tfidf.tfidf_weights(frequencies, tfidf.fit_tfidf(docs), "doc_id")
    return weights.select("doc_id", "term", F.round("w", 6).alias("w"))


# Author vectors of both sides: qv and tv (label, term, w), unit length.
AUTHOR_VECTORS = f"""{DOCS}, {q.TFIDF},
sp AS (SELECT doc_id, text, CAST(substr(source, 4) AS BIGINT) AS label, (doc_id // 20) % 2 AS side FROM documents),
atk AS (SELECT side, label, unnest(regexp_extract_all(text, '{q.TOKEN}')) AS term FROM sp),
af AS (SELECT side, label, term, count(*) AS tf FROM atk
       WHERE term NOT IN (SELECT term FROM stop) GROUP BY side, label, term),
aw AS (SELECT side, label, term, af.tf * idf AS raw FROM af JOIN model USING (term)),
av AS (SELECT side, label, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, label)) AS w FROM aw),
people AS (SELECT DISTINCT side, label FROM sp),
dp AS (SELECT a.label AS q, b.label AS t, sum(a.w * b.w) AS s
       FROM av a JOIN av b ON a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY a.label, b.label),
sc AS (SELECT a.label AS q, b.label AS t, a.label = b.label AS same, coalesce(s, 0) AS s
       FROM people a JOIN people b ON a.side = 0 AND b.side = 1 LEFT JOIN dp ON dp.q = a.label AND dp.t = b.label)"""


@query("sparse_dot_join", f"""
WITH {AUTHOR_VECTORS}
SELECT q, count(*) AS n_targets, round(sum(s), 6) AS score_sum, round(min(s), 6) AS score_min, round(max(s), 6) AS score_max
FROM sc GROUP BY q""")
def sparse_dot_join(spark, sf):
    """Dot products of sparse vectors, block against block; frequent terms cost no more than others."""
    queries, targets = inputs.source_posts(spark, sf)
    model = tfidf.fit_tfidf(inputs.texts(spark, sf))
    stats = pairs.score_statistics(
        settle(tfidf.author_vectors(queries, model)), settle(tfidf.author_vectors(targets, model)),
        metric="linear", decimals=12)
    return stats.select("q", "n_targets", *[F.round(c, 6).alias(c) for c in ("score_sum", "score_min", "score_max")])


@query("tfidf_linking", f"""
WITH {AUTHOR_VECTORS},
counts AS (SELECT round(s, 7) + 0.0::DOUBLE AS score, count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg
           FROM sc GROUP BY 1), {q.CURVE} {q.LINK_METRICS}""")
def tfidf_linking(spark, sf):
    """All posts of a query author against all posts of a target author; whole texts."""
    queries, targets = inputs.source_posts(spark, sf)
    return rounded(tfidf.tfidf_linking(queries, targets, tfidf.fit_tfidf(inputs.texts(spark, sf))))


# --- mining ----------------------------------------------------------------------------------------------------


@query("batch_self_join", f"""
WITH {q.BATCH_PAIRS}
SELECT batch_id, anchor, count(*) FILTER (same) AS n_pos, count(*) FILTER (NOT same) AS n_neg,
       round(coalesce(sum(score) FILTER (same), 0), 6) + 0.0::DOUBLE AS pos_sum,
       round(coalesce(sum(score) FILTER (NOT same), 0), 6) + 0.0::DOUBLE AS neg_sum
FROM pr GROUP BY batch_id, anchor""")
def batch_self_join(spark, sf):
    """Each anchor against its whole batch, margin added to negatives; one row per anchor."""
    report = mining.anchor_report(inputs.batches(spark, sf), 0.25)
    return report.select("batch_id", "anchor", "n_pos", "n_neg", (F.round("pos_sum", 6) + 0.0).alias("pos_sum"),
                         (F.round("neg_sum", 6) + 0.0).alias("neg_sum"))


RANKED = f"""{q.BATCH_PAIRS},
o AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC) AS rn,
             count(*) FILTER (same) OVER (PARTITION BY anchor) AS n_pos FROM pr),
k AS (SELECT *, max(CASE WHEN rn = {{k}} THEN score END) OVER (PARTITION BY anchor) AS kth FROM o),
f AS (SELECT *, NOT same AND score >= kth AS intruding, same AND score < kth AS missed FROM k),
g AS (SELECT *, count(*) FILTER (intruding) OVER (PARTITION BY anchor) AS n_intruding,
             count(*) FILTER (missed) OVER (PARTITION BY anchor) AS n_missed,
             row_number() OVER (PARTITION BY anchor, intruding ORDER BY score) AS low,
             row_number() OVER (PARTITION BY anchor, missed ORDER BY score DESC) AS high FROM f),
rl AS (
  SELECT batch_id, anchor, any_value(CASE WHEN n_pos < {{k}} THEN 1 ELSE 2 END) AS loss_case, any_value(n_pos) AS n_pos,
         any_value(kth) AS kth, any_value(n_intruding) AS n_intruding, any_value(n_missed) AS n_missed,
         coalesce(sum(score) FILTER (intruding AND (n_pos >= {{k}} OR low <= n_missed)), 0) AS neg_part,
         coalesce(sum(score) FILTER (missed AND (n_pos < {{k}} OR high <= n_intruding)), 0) AS pos_part
  FROM g GROUP BY batch_id, anchor)"""
K = 6


def ranked_report(spark, sf):
    return mining.ranked_list_report(inputs.batches(spark, sf), 0.25, K)


@query("kth_score", f"WITH {RANKED.format(k=K)} SELECT batch_id, anchor, round(kth, 6) + 0.0::DOUBLE AS kth_score FROM rl")
def kth_score(spark, sf):
    return ranked_report(spark, sf).select("batch_id", "anchor", (F.round("kth_score", 6) + 0.0).alias("kth_score"))


@query("topk_in_row", f"""
WITH {RANKED.format(k=K)}
SELECT batch_id, anchor, loss_case::BIGINT AS loss_case, n_pos, n_intruding, n_missed,
       round(neg_part, 6) + 0.0::DOUBLE AS neg_part, round(pos_part, 6) + 0.0::DOUBLE AS pos_part FROM rl""")
def topk_in_row(spark, sf):
    return ranked_report(spark, sf).select(
        "batch_id", "anchor", "loss_case", "n_pos", "n_intruding", "n_missed",
        (F.round("neg_part", 6) + 0.0).alias("neg_part"), (F.round("pos_part", 6) + 0.0).alias("pos_part"))


@query("ranked_list_score", f"""
WITH {RANKED.format(k=K)}, b AS (SELECT batch_id, count(*) AS n FROM unit GROUP BY batch_id)
SELECT batch_id, c AS loss_case, count(*) FILTER (loss_case = c) AS n_anchors,
       round(coalesce(sum(neg_part - pos_part) FILTER (loss_case = c), 0) / any_value(n), 6) + 0.0::DOUBLE AS score
FROM rl JOIN b USING (batch_id), (VALUES (1::BIGINT), (2)) v(c) GROUP BY batch_id, c""")
def ranked_list_score(spark, sf):
    report = settle(ranked_report(spark, sf))
    both = [mining.ranked_list_score(report, run_case1=case == 1).withColumn("loss_case", F.lit(case).cast("bigint"))
            for case in (1, 2)]
    return both[0].unionByName(both[1]).select("batch_id", "loss_case", "n_anchors", (F.round("score", 6) + 0.0).alias("score"))


@query("semihard_triplets", f"""
WITH {q.BATCH_PAIRS},
p AS (SELECT batch_id, anchor, other, dist FROM pr WHERE same),
t AS (SELECT p.batch_id, p.anchor, p.other, p.dist, min(n.dist) FILTER (n.dist > p.dist) AS outside, max(n.dist) AS inside
      FROM p JOIN pr n ON n.anchor = p.anchor AND NOT n.same GROUP BY p.batch_id, p.anchor, p.other, p.dist)
SELECT batch_id, count(*) AS n_triplets, round(avg(greatest(0.2::DOUBLE + dist - coalesce(outside, inside), 0)), 6) AS score
FROM t GROUP BY batch_id""")
def semihard_triplets(spark, sf):
    scored = mining.triplet_score(mining.semihard_triplets(inputs.batches(spark, sf), 0.2))
    return scored.select("batch_id", "n_triplets", F.round("score", 6).alias("score"))


# --- episode features ------------------------------------------------------------------------------------------

N_ACTIONS = inputs.ACTION_VOCAB
WIDTH = features.NGRAM_BUCKETS + N_ACTIONS + features.HOURS

GRAMS = f"""wd AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
gr AS (SELECT DISTINCT doc_id, {q.word_hash('g')} % {features.NGRAM_BUCKETS} AS feature FROM (
  {' UNION ALL '.join(
      f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' '))) AS g FROM wd"
      for n in features.NGRAM_WIDTHS)}))"""


def episode_members(spark, sf, samples, seed):
    """Posts of the sampled episodes with their feature indices. Episodes are drawn on ids; n-grams are
    hashed once per document that was drawn, so that joins move a few integers per post."""
    spec = episodes.contiguous_spec(episodes.draw_samples(counts(spark, sf), seed, samples), seed, drop_short=True)
    return members_of(spark, sf, spec)


def members_of(spark, sf, spec):
    posts = inputs.timeline(spark, sf).withColumn("author_id", F.col("author").cast("bigint"))
    members = settle(episodes.episode_posts(episodes.spec_positions(spec), posts).withColumn(
        "doc_id", F.col("post_id") % inputs.documents(spark, sf).count()))
    # Only texts that a drawn post has are read into n-grams, each once.
    drawn = inputs.documents(spark, sf).join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = spread(drawn, "doc_id").select("doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", features.ngram_buckets(F.col("w")).alias("grams"))
    described = history.with_calendar(history.lookup_action(members, inputs.actions(spark, sf))).join(docs, "doc_id")
    return described.select(
        "author_id", F.col("sample_no").cast("bigint").alias("sample_no"), "ep_pos",
        features.post_features(F.col("grams"), F.col("action_id"), F.col("hour"), N_ACTIONS).alias("features"))


def member_sql(seed: str, samples: int) -> str:
    return f"""{q.TL}, {q.ACTIONS}, {draws(seed, samples)}, {GRAMS},
mb AS (SELECT author_id, sample_no, pos - start AS ep_pos, post_id % (SELECT count(*) FROM documents) AS doc_id,
              (created_utc // 3600) % 24 AS hour, coalesce(act.action_id, 4) AS action_id
       FROM sp JOIN tl ON CAST(author AS BIGINT) = author_id AND pos >= start AND pos < start + length
       LEFT JOIN act ON act.action = community),
ft AS (SELECT author_id, sample_no, ep_pos, feature FROM mb JOIN gr USING (doc_id)
       UNION ALL SELECT author_id, sample_no, ep_pos, {features.NGRAM_BUCKETS} + action_id FROM mb
       UNION ALL SELECT author_id, sample_no, ep_pos, {features.NGRAM_BUCKETS + N_ACTIONS} + hour FROM mb),
sz AS (SELECT author_id, sample_no, count(*) AS n_posts FROM mb GROUP BY author_id, sample_no),
pooled AS (SELECT author_id, sample_no, feature, count(*) / any_value(n_posts) AS mean_value
           FROM ft JOIN sz USING (author_id, sample_no) GROUP BY author_id, sample_no, feature)"""


@query("episode_features", f"""
WITH {member_sql('features', 2)}
SELECT author_id, sample_no, ep_pos, count(*) AS n_features, sum(feature)::BIGINT AS feature_sum,
       sum(feature * feature)::BIGINT AS feature_square FROM ft GROUP BY author_id, sample_no, ep_pos""")
def episode_features(spark, sf):
    rows = episode_members(spark, sf, 2, "features")
    total = F.aggregate("features", F.lit(0), lambda acc, x: acc + x)
    square = F.aggregate("features", F.lit(0), lambda acc, x: acc + x * x)
    return rows.select("author_id", "sample_no", "ep_pos", F.size("features").cast("bigint").alias("n_features"),
                       total.cast("bigint").alias("feature_sum"), square.cast("bigint").alias("feature_square"))


@query("pool_posts", f"""
WITH {member_sql('features', 2)}
SELECT author_id, sample_no, feature, 1.0::DOUBLE AS max_value, round(mean_value, 6) AS mean_value FROM pooled""")
def pool_posts(spark, sf):
    pooled = features.pool_posts(episode_members(spark, sf, 2, "features"), ["author_id", "sample_no"])
    return pooled.select("author_id", "sample_no", F.col("feature").cast("bigint").alias("feature"), "max_value",
                         F.round("mean_value", 6).alias("mean_value"))


@query("pool_vectors", f"""
WITH {q.EMB}, x AS (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM emb),
s AS (SELECT label, i, max(v) AS mx, avg(v) AS me FROM x GROUP BY label, i)
SELECT label, i - 1 AS dim, round(mx, 6) + 0.0::DOUBLE AS value FROM s
UNION ALL SELECT label, i + 63, round(me, 6) + 0.0::DOUBLE FROM s""")
def pool_vectors(spark, sf):
    pooled = features.pool_vectors(inputs.embeddings(spark, sf), ["label"])
    return pooled.select("label", F.posexplode("vec").alias("dim", "v")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), (F.round("v", 6) + 0.0).alias("value"))


UNIT = "nv AS (SELECT author_id, sample_no, sqrt(sum(1 + mean_value * mean_value)) AS size FROM pooled GROUP BY author_id, sample_no)"


@query("embed_episodes", f"""
WITH {member_sql('features', 2)}, {UNIT}
SELECT author_id, sample_no, {2 * WIDTH}::BIGINT AS dims, round(sum(1 + mean_value) / any_value(size), 6) AS total
FROM pooled JOIN nv USING (author_id, sample_no) GROUP BY author_id, sample_no""")
def embed_episodes(spark, sf):
    """Unit vectors of all sampled episodes."""
    pooled = features.pool_posts(episode_members(spark, sf, 2, "features"), ["author_id", "sample_no"])
    vectors = features.episode_vectors(pooled, ["author_id", "sample_no"], WIDTH)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return vectors.select("author_id", "sample_no", F.size("vec").cast("bigint").alias("dims"), F.round(total, 6).alias("total"))


@query("contrastive_score", f"""
WITH {member_sql('pairs', 3)}, {UNIT},
{PAIRS[PAIRS.index('ring AS'):]},
ev2 AS (SELECT author_id, sample_no, feature, 1 / size AS peak, mean_value / size AS mean_value FROM pooled JOIN nv USING (author_id, sample_no)),
pp AS (SELECT l, 0 AS ls, r, 1 AS rs, is_same FROM pos_pairs UNION ALL SELECT l, 0, r, 2, is_same FROM neg_pairs),
dt AS (SELECT pp.l, pp.r, pp.rs, any_value(is_same) AS is_same, sum(a.peak * b.peak + a.mean_value * b.mean_value) AS dot
       FROM pp JOIN ev2 a ON a.author_id = l AND a.sample_no = ls
       JOIN ev2 b ON b.author_id = r AND b.sample_no = rs AND b.feature = a.feature GROUP BY pp.l, pp.r, pp.rs),
ds AS (SELECT is_same, sqrt(greatest(0, 2 - 2 * dot)) AS d FROM dt)
SELECT count(*) AS n_pairs, sum(is_same)::BIGINT AS n_same,
       round(avg(CASE WHEN is_same = 1 THEN d * d ELSE greatest(1 - d, 0) * greatest(1 - d, 0) END), 6) AS score FROM ds""")
def contrastive_score(spark, sf):
    """Contrastive score of the labelled episode pairs, over the episode vectors."""
    spec = pair_samples(spark, sf)
    pooled = features.pool_posts(members_of(spark, sf, spec), ["author_id", "sample_no"])
    vectors = features.episode_vectors(pooled, ["author_id", "sample_no"], WIDTH)
    # The pairs read the vectors four times.
    samples = settle(spec.withColumn("sample_no", F.col("sample_no").cast("bigint")).join(
        vectors, ["author_id", "sample_no"]).select("author_id", "sample_no", "vec"))
    labelled = episodes.labelled_pairs(samples, "pairs").select(
        F.col("left.vec").alias("left_vec"), F.col("right.vec").alias("right_vec"), "is_same")
    return rounded(mining.contrastive_score(labelled))

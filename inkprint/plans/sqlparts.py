"""Shared pieces of the SQL twins."""

from inkprint.functions.text import STOP_WORDS

# Words and tokens as the SQL engine's regular expressions see them.
WORD = r"[^\t-\r\x1c-\x1f \x85\p{Z}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def hash32(seed: str, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8) AS BIGINT)"


def word_hash(word: str) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, 8) AS BIGINT)"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def alpha_fraction(text: str) -> str:
    return f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g')) / nullif(length({text}), 0)"


def keep(text: str) -> str:
    return f"coalesce(length({text}) >= 1 AND {alpha_fraction(text)} >= 0.75, false)"


def syms(text: str) -> str:
    return f"list_transform({words(text)}, lambda w: {word_hash('w')} % 65533 + 3)"


def joined(values: str) -> str:
    return f"array_to_string({values}, ',')"


EV = """ev AS (
  SELECT event_id AS post_id, CAST(user_id AS VARCHAR) AS author, event_type AS community,
         CAST(floor(epoch(ts)) AS BIGINT) AS created_utc
  FROM events)"""
TL = EV + """,
tl AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc, post_id) - 1 AS pos FROM ev)"""
ACTIONS = """act AS (
  SELECT action, action_id FROM (
    SELECT event_type AS action, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS action_id
    FROM events GROUP BY event_type)
  WHERE action_id < 4
  UNION ALL SELECT '<unk>', 4)"""
# Encoded posts of the events table: one row per post with symbols, calendar parts and action id.
EP = TL + ", " + ACTIONS + f""",
docs AS (SELECT doc_id, {syms('text')} AS syms FROM documents),
ep AS (
  SELECT CAST(author AS BIGINT) AS author_id, pos, post_id, syms, community,
         (created_utc // 3600) % 24 AS hour, (created_utc // 60) % 60 AS minute,
         (created_utc // 86400 + 3) % 7 AS day, coalesce(act.action_id, 4) AS action_id
  FROM tl JOIN docs ON docs.doc_id = post_id % (SELECT count(*) FROM documents)
  LEFT JOIN act ON act.action = community)"""
HIST = EP + """,
hist AS (
  SELECT author_id, pos // 1024 AS segment, list(syms ORDER BY pos) AS syms, list(hour ORDER BY pos) AS hour,
         list(minute ORDER BY pos) AS minute, list(day ORDER BY pos) AS day, list(action_id ORDER BY pos) AS action_type
  FROM ep GROUP BY author_id, pos // 1024),
whole AS (SELECT author_id, list(hour ORDER BY pos) AS hour, list(action_id ORDER BY pos) AS action_type
          FROM ep GROUP BY author_id)"""
EMB = "emb AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
MEANS = EMB + """,
flat AS (SELECT id, label, id % 2 AS side, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM emb),
dims AS (SELECT label, side, i, avg(x) AS x FROM flat GROUP BY label, side, i),
means AS (SELECT label, side, list(x ORDER BY i) AS vec FROM dims GROUP BY label, side)"""
TRIALS = f"""tr AS (
  SELECT doc_id AS id, round({alpha_fraction('text')}, 6) AS score, quality AS is_match
  FROM documents JOIN labels USING (doc_id))"""
# From scores(score, pos, neg): the curve, best score first.
CURVE = """
cv AS (
  SELECT score, pos, neg, sum(pos) OVER w AS true_pos, sum(neg) OVER w AS false_pos,
         sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg,
         lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS rn
  FROM counts WINDOW w AS (ORDER BY score DESC)),
curve AS (
  SELECT *, (rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg) AS kept,
         false_pos / n_neg AS fpr, true_pos / n_pos AS tpr,
         (false_pos - neg) / n_neg AS f0, (true_pos - pos) / n_pos AS t0
  FROM cv)"""
TRIAL_COUNTS = TRIALS + """,
counts AS (SELECT score, sum(is_match)::BIGINT AS pos, sum(1 - is_match)::BIGINT AS neg FROM tr GROUP BY score)"""
LINK_METRICS = """
SELECT
  (SELECT round(sum(pos * (n_neg - false_pos + neg / 2)) / max(n_pos * n_neg), 6) FROM curve) AS auc_roc,
  (SELECT round(CASE WHEN min(abs((1 - tpr) - fpr)) < 1
          THEN arg_min(fpr, (abs((1 - tpr) - fpr), -score)) ELSE 0 END, 6) FROM curve WHERE kept) AS eer,
  (SELECT round(max(f0 + (fpr - f0) * (1 - f0 - t0) / ((fpr - f0) + (tpr - t0))), 6) FROM curve
    WHERE 1 - f0 - t0 > 0 AND 1 - fpr - tpr <= 0) AS eer_v2,
  (SELECT round(min((n_pos - true_pos + pos) / n_pos * 0.01::DOUBLE + (false_pos - neg) / n_neg * 0.99::DOUBLE)
          / 0.01::DOUBLE, 6) FROM curve) AS min_dcf"""
STOP = "stop(term) AS (VALUES " + ", ".join("('" + w.replace("'", "''") + "')" for w in STOP_WORDS) + ")"
# From docs(doc, text): tok(doc, term), tf(doc, term, tf), terms(term, df, total_tf, idf).
TFIDF = STOP + f""",
tok AS (
  SELECT doc, term FROM (SELECT doc, unnest(regexp_extract_all(text, '{TOKEN}')) AS term FROM docs)
  WHERE term NOT IN (SELECT term FROM stop)),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term),
terms AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf,
         ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + count(*))) + 1 AS idf
  FROM tf GROUP BY term),
model AS (
  SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (
    SELECT * FROM terms WHERE df <= 0.9::DOUBLE * (SELECT count(*) FROM docs)
    ORDER BY total_tf DESC, term LIMIT 20000))"""
BATCH_PAIRS = EMB + """,
unit AS (SELECT id, id // 512 AS batch_id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec
         FROM emb),
pr AS (
  SELECT a.batch_id, a.id AS anchor, b.id AS other, a.label = b.label AS same,
         list_dot_product(a.vec, b.vec) + CASE WHEN a.label = b.label THEN 0 ELSE 0.25::DOUBLE END AS score,
         sqrt(greatest(0, list_dot_product(a.vec, a.vec) + list_dot_product(b.vec, b.vec)
                          - 2 * list_dot_product(a.vec, b.vec))) AS dist
  FROM unit a JOIN unit b ON a.batch_id = b.batch_id AND a.id <> b.id)"""

"""The operators as registered queries over the driver tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkprint.llm import (
    bpe, collocation, embedding_dedup, html_text, language, minhash_dedup, mixing, packing, periodic, quality,
    suffix_dedup, topk, warc)
from inkprint.llm.common import ASCII_WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_topk_pivot(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 1024)
    found = topk.top_k(vectors, vectors.where("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op1_topk_pivot"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
  WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op3_mix_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf, "documents")))


ORACLES["op3_mix_schedule"] = mixing.ORACLE


@query
def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents"), window=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op4_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (
  SELECT no, doc_id, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i, h FROM d),
v AS (SELECT no, doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM w),
m AS (SELECT k, min(doc_id) AS least FROM v GROUP BY k),
c AS (SELECT v.no, v.i FROM v JOIN m ON v.k = m.k WHERE v.doc_id > m.least),
g AS (SELECT no, i, i - lag(i) OVER (PARTITION BY no ORDER BY i) AS step FROM c),
s AS (SELECT no, i, sum(CASE WHEN step IS NULL OR step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY no ORDER BY i) AS s FROM g),
spans AS (SELECT no, s, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY no, s),
l AS (SELECT no, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n_removed FROM spans GROUP BY no)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(l.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(len(l.a), 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN l.a IS NULL THEN d.h ELSE
         array_to_string(list_transform(range(0, len(l.a) + 1), lambda i:
           substr(d.h, 2 * CASE WHEN i = 0 THEN 0 ELSE l.b[i] END + 1,
                  2 * (CASE WHEN i = len(l.a) THEN len(d.h) // 2 ELSE l.a[i + 1] END
                       - CASE WHEN i = 0 THEN 0 ELSE l.b[i] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN l ON d.no = l.no
"""


@query
def op5_minmax_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf, "documents"))


ORACLES["op5_minmax_dedup"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op6_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"), threshold=0.9)


ORACLES["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
  WHERE list_cosine_similarity(a.w, b.w) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT c.node AS vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id,
       c.node = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.node
"""


@query
def op8_pack_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0,
                        keep_ids=False)


@query
def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(
        language.remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = language.fit(docs.where("not held_out"), tokenizer_file("piece_bpe_32k.model"))
    return language.predict(docs, model, ["doc_id", "held_out"])


@query
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(
        language.remainder(F.col("doc_id"), 5) == 0, F.lit(False)))
    labels = table(spark, sf, "labels").where(language.remainder(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"), ["page_id", "url"])


WEEK = 7 * 86_400


def page_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a WARC response, and a week later as a not-modified revisit under another spelling of its URL.
    Pages are a minute apart, so another page of the same canonical URL may have been fetched in between."""
    pages = table(spark, sf, "pages").withColumn("body", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))
    time = F.lit(1_600_000_000) + F.col("page_id") * 60

    def stamp(seconds: Column) -> Column:
        return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    tag = F.concat(F.lit('ETag: "'), F.md5("body"), F.lit('"\r\n'))
    name = F.col("page_id").cast("string")
    response = warc.to_record(
        F.lit("response"), F.concat(F.lit("page:"), name), F.col("url"), stamp(time), F.lit("200 OK"),
        F.concat(tag, F.lit("Content-Type: text/html\r\nCache-Control: no-cache\r\nContent-Length: "),
                 F.length("body").cast("string"), F.lit("\r\n")), F.col("body"))
    revisit = warc.to_record(
        F.lit("revisit"), F.concat(F.lit("again:"), name), F.concat(F.col("url"), F.lit("#again")), stamp(time + WEEK),
        F.lit("304 Not Modified"),
        F.concat(F.lit("Cache-Control: max-age="), name, F.lit("\r\nContent-Length: 0\r\n"), tag), F.col("body"))
    return pages.select(F.explode(F.array(response, revisit)).alias("record"))


@query
def op7_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.resolve(warc.parse(page_records(spark, sf)))
    number = F.substring_index("record_id", ":", -1).cast("bigint")
    return found.select(
        number.alias("page_id"), "url", "canonical", F.substring_index("refers_to", ":", -1).cast("bigint").alias("refers_to"),
        "outcome", F.element_at("headers", F.lit("cache-control")).alias("cache_control"),
        F.length("body").cast("bigint").alias("content_length"),
        F.element_at("headers", F.lit("content-type")).alias("content_type"),
        F.concat(F.lit("md5:"), F.md5("body")).alias("digest"))


ORACLES["op7_warc_revisits"] = r"""
WITH u AS (
  SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS p FROM pages),
h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(
      lower(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(p, '^[^:/?]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'), lambda x: x <> ''
      AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=.*)?$'))) AS q
  FROM u),
c AS (
  SELECT page_id, url, html, md5(html) AS tag, octet_length(encode(html)) AS n,
    CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END
      AS canonical
  FROM h),
r AS (
  SELECT a.page_id, max(b.page_id) AS refers_to FROM c a JOIN c b
  ON a.canonical = b.canonical AND b.page_id * 60 < a.page_id * 60 + 604800 GROUP BY a.page_id)
SELECT a.page_id, a.url || '#again' AS url, a.canonical, r.refers_to,
  CASE WHEN a.canonical IS NULL THEN 'no_url' WHEN r.refers_to IS NULL THEN 'no_response'
       WHEN a.tag <> b.tag THEN 'tag_differs' ELSE 'resolved' END AS outcome,
  CASE WHEN a.tag = b.tag THEN 'max-age=' || a.page_id END AS cache_control,
  CASE WHEN a.tag = b.tag THEN CAST(b.n AS BIGINT) END AS content_length,
  CASE WHEN a.tag = b.tag THEN 'text/html' END AS content_type,
  CASE WHEN a.tag = b.tag THEN 'md5:' || b.tag END AS digest
FROM c a LEFT JOIN r ON r.page_id = a.page_id LEFT JOIN c b ON b.page_id = r.refers_to
"""


@query
def op11_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"), ["doc_id"], decoded=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def with_tails(docs: DataFrame) -> DataFrame:
    """The documents' texts; in those whose crc32 of the id ends in 0, the words from some place on repeat the first few
    of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    listed = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(ASCII_WORD), F.lit(0))).alias("words"))
    placed = listed.withColumn("a", F.when(F.size("words") > 0, F.col("g") % F.size("words")).cast("int"))
    left = F.size("words") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.find_runs(with_tails(table(spark, sf, "documents")), ["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best["start"]).alias("start"),
        best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLES["op12_periodic_runs"] = r"""
WITH RECURSIVE bits AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents
  UNION ALL
  SELECT doc_id, s, k + 1, xor(x // 2, (x % 2) * 3988292384)
  FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE c END AS x
        FROM bits WHERE k < 8 * len(s))),
crc AS (SELECT doc_id, xor(c, 4294967295) AS h FROM bits WHERE k = 8 * len(s)),
t AS (
  SELECT row_number() OVER () AS no, d.doc_id, h, h // 10 AS g,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (
  SELECT no, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM p),
x AS (SELECT no, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
g AS (SELECT no, i, array_to_string(w[i + 1:i + 6], ' ') AS gram
      FROM (SELECT no, unnest(range(0, greatest(n - 5, 0))) AS i, w FROM d)),
e AS (SELECT a.no, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.no = b.no AND a.gram = b.gram AND a.i < b.i),
f AS (SELECT no, q, i, i - row_number() OVER (PARTITION BY no, q ORDER BY i) AS island FROM e),
s AS (SELECT no, q, min(i) AS start, count(*) + 5 + q AS length FROM f GROUP BY no, q, island),
r AS (SELECT no, start, length, min(q) AS q FROM s WHERE length >= greatest(12, 2 * q) GROUP BY no, start, length),
best AS (
  SELECT no, count(*) AS n_runs, first(struct_pack(start := start, length := length, q := q)
                                       ORDER BY length DESC, start, q) AS b,
         string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM r GROUP BY no),
gone AS (SELECT DISTINCT no, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT no, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (no, i) GROUP BY no)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.q AS period,
       1000 * b.length // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.no = d.no LEFT JOIN kept ON kept.no = d.no
"""


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocation.mine(table(spark, sf, "documents"), least=100, longest=5, top=2000)


ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(
    range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))))) AS phrase
  FROM w),
f AS (SELECT lang, phrase, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
cut AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, x.f AS l, y.f AS r, n.n, k,
    CAST(CAST(1000 AS HUGEINT) * cut.a * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  JOIN n ON n.lang = cut.lang),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
inner_ AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda k: list_transform(
    range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))))) AS phrase
  FROM c),
held AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY lang, phrase),
kept AS (
  SELECT s.lang, s.phrase, a, l, r, n, score FROM least s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE place = 1 AND (h.most IS NULL OR h.most < a)),
ranked AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank,
         phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""

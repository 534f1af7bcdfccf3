"""Not-modified revisits in web archives: resolve each to the full response it stands for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.operators.prefix import with_range_bucket
from inkprint.session import broadcast_if_small, settle, spread

SALTS = 64
HOT_REVISITS = 1000  # revisits of one response that a task joins
MAX_BROADCAST_HOT = 100_000
ROWS_PER_BUCKET = 50_000
#: Headers that describe one message, not the stored content; a 304 does not change them (fixed names of HTTP).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=.*)?$"
RECORD = ("record_id string, type string, url string, time string, digest string, status int, "
          "headers map<string,string>, body binary")
_BREAK = re.compile(rb"\r?\n\r?\n")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., user and port, path without a final slash, sorted query without tracking
    parameters; no scheme, no fragment. Null if it is not a URL with a host."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^:/?]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(
        F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def to_record(kind: Column, record_id: Column, url: Column, time: Column, status: Column, headers: Column,
              body: Column) -> Column:
    """One WARC record as bytes. `headers` is the block of HTTP header lines, each with its line end; a revisit has no
    body of its own but the digest of what it stands for."""
    message = F.concat(F.encode(F.concat(F.lit("HTTP/1.1 "), status, F.lit("\r\n"), headers, F.lit("\r\n")), "UTF-8"),
                       F.when(kind == "response", body).otherwise(F.lit(b"")))
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), record_id,
             F.lit(">\r\nWARC-Date: "), time, F.lit("\r\n"),
             F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
             F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n"
                                             )).otherwise(F.lit("")),
             F.lit("WARC-Payload-Digest: md5:"), F.md5(body),
             F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
             F.length(message).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(F.encode(F.concat(*lines), "UTF-8"), message, F.lit(b"\r\n\r\n"))


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    """First line, and header fields by lower-case name; repeated names are joined, folded lines unfolded."""
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", block).decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon and name.strip():
            name = name.strip().lower()
            found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return first, found


def parse_record(data: bytes) -> tuple | None:
    """Fields of one record; null for bytes that are none."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, warc = _fields(head)
    if not first.startswith("WARC/"):
        return None
    length = warc.get("content-length", "")
    block = rest[:int(length)] if length.isascii() and length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    status, headers, body = None, {}, b""
    if "http" in warc.get("content-type", ""):
        cut = _BREAK.search(block)
        line, headers = _fields(block[:cut.start()] if cut else block)
        body = block[cut.end():] if cut else b""
        found = re.match(r"HTTP/\S+\s+(\d{3})", line)
        status = int(found[1]) if found else None
    return (warc.get("warc-record-id", "").strip("<>") or None, warc.get("warc-type"), warc.get("warc-target-uri"),
            warc.get("warc-date"), warc.get("warc-payload-digest"), status, list(headers.items()), body)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 5 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]
    for batch in batches:
        rows = [r for r in (parse_record(d.as_py() or b"") for d in batch.column(0)) if r]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def parse(records: DataFrame, column: str = "record") -> DataFrame:
    """Fields of WARC records, one record per row: type, ids, HTTP status, headers (lower-case names) and body. Bytes
    that are no record, and nulls, give no row."""
    return spread(records.select(column)).mapInArrow(_parse, RECORD)


def resolve(records: DataFrame, bodies: bool = True, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per not-modified revisit of `records` (the fields of `parse`, with time as anything that orders).

    Columns: record_id, url, canonical, time, refers_to, refers_time, outcome, headers, digest, body (unless `bodies` is
    off). A revisit refers to the latest full response (status 200) of its canonical URL that is earlier; of equal
    times the one with the largest record id. The outcome is `resolved` if the validators that both have agree: the
    entity tag (weak comparison), the payload digest, and without a tag the modification date. Otherwise it is
    `no_response`, `tag_differs`, `digest_differs`, `date_differs` or `no_url`; headers and body are then null. Resolved
    headers are those of the response, updated by those of the revisit that a 304 may change.

    The as-of join runs on one row per URL and time without bodies. Times are cut in buckets of about
    `rows_per_bucket` rows, and each URL carries its last response from bucket to bucket, so a URL with a third of all
    captures is split like the rest. Headers and bodies are joined by record id at the end.

    Defined cases: null urls give `no_url`, null or malformed times `no_response`, and responses with such times are
    none; a malformed length takes the whole record; repeated revisits give repeated rows, repeated
    responses count once; an empty table gives no rows; other columns are ignored.
    """
    rows = records.select("record_id", "type", "url", "time", "digest", "status", "headers",
                          *(["body"] if bodies else []))
    rows = settle(rows.withColumn("canonical", canonical_url(F.col("url"))).withColumn(
        "tag", F.regexp_replace(F.element_at("headers", F.lit("etag")), "^W/", "")).withColumn(
        "modified", F.element_at("headers", F.lit("last-modified"))))
    full = rows.where("type = 'response' and status = 200 and canonical is not null and time is not null")
    revisits = rows.where("type = 'revisit' and coalesce(status, 304) = 304")
    facts = F.struct("record_id", F.col("time").alias("at"), "tag", "modified", "digest")
    seen = full.groupBy("canonical", "time").agg(F.max_by(facts, "record_id").alias("response"))
    asked = revisits.where("canonical is not null and time is not null").select("canonical", "time").distinct()
    line = seen.join(asked, ["canonical", "time"], "full_outer")
    line = settle(line.withColumn("order", F.try_to_timestamp("time")).where("order is not null"))
    line = with_range_bucket(line, ["order", "time", "canonical"], line.count() // rows_per_bucket + 1, "bucket")
    of_bucket = line.where("response is not null").groupBy("canonical", "bucket").agg(
        F.max_by("response", F.struct("order", "time")).alias("last"))
    marks = line.select("canonical", "bucket").distinct().join(of_bucket, ["canonical", "bucket"], "left")
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("canonical", "bucket", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "bucket").orderBy("order", "time").rowsBetween(Window.unboundedPreceding, -1)
    latest = line.join(carried, ["canonical", "bucket"]).select("canonical", "time", F.coalesce(
        F.last("response", ignorenulls=True).over(inside), F.col("carried")).alias("response"))
    found = revisits.drop("type", "status", "body").join(latest, ["canonical", "time"], "left")

    def differ(name: str) -> Column:
        return F.coalesce(F.col(name) != F.col(f"response.{name}"), F.lit(False))

    no_tag = F.col("tag").isNull() | F.col("response.tag").isNull()
    outcome = (F.when(F.col("canonical").isNull(), "no_url").when(F.col("response").isNull(), "no_response")
               .when(differ("tag"), "tag_differs").when(differ("digest"), "digest_differs")
               .when(no_tag & differ("modified"), "date_differs").otherwise("resolved"))
    found = found.withColumn("outcome", outcome).withColumn("refers_to", F.col("response.record_id"))
    # Revisits without a response need no look-up. Responses with very many revisits are copied to SALTS places and
    # their revisits dealt among them; all others have one place, so a body is moved once.
    asking = found.where("refers_to is not null")
    hot = settle(asking.groupBy("refers_to").agg(F.count("*").alias("n")).where(F.col("n") > HOT_REVISITS).select(
        "refers_to", F.lit(SALTS).alias("places")))
    hot = broadcast_if_small(hot, MAX_BROADCAST_HOT)
    places = F.coalesce("places", F.lit(1))
    salted = asking.join(hot, "refers_to", "left").withColumn(
        "salt", F.pmod(F.xxhash64("record_id"), places).cast("int")).drop("places")
    stored = full.select(F.col("record_id").alias("refers_to"), F.col("headers").alias("old"),
                         F.col("digest").alias("old_digest"), *(["body"] if bodies else []))
    copies = stored.join(hot, "refers_to", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), places - 1))).drop("places").dropDuplicates(["refers_to", "salt"])
    joined = salted.join(copies, ["refers_to", "salt"], "left").drop("salt").unionByName(
        found.where("refers_to is null"), allowMissingColumns=True)
    news = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(news), k)), news)
    ok = F.col("outcome") == "resolved"
    return joined.select("record_id", "url", "canonical", "time", "refers_to", F.col("response.at").alias("refers_time"),
                         "outcome", F.when(ok, merged).alias("headers"), F.when(ok, F.col("old_digest")).alias("digest"),
                         *([F.when(ok, F.col("body")).alias("body")] if bodies else []))

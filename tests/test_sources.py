import datetime
import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from inkprint.operators.records import FeatureConfig
from inkprint.operators.vocab import corpus_lines
from inkprint.plans import inputs
from inkprint.sources import readers, writers
from inkprint.streaming.posts import prepare_posts, read_comment_stream


def test_text_readers(spark, tmp_path):
    (tmp_path / "ids").write_text("5 3  9\n\n7\n")
    assert sorted(map(tuple, readers.read_id_lists(spark, str(tmp_path / "ids")).collect())) == [
        (5, 0, 5), (5, 1, 3), (5, 2, 9), (7, 0, 7)]
    assert sorted(r.post_id for r in readers.read_heldout_ids(spark, str(tmp_path / "ids")).collect()) == [3, 5, 7, 9]


def test_json_readers(spark, tmp_path):
    with gzip.open(tmp_path / "c.json.gz", "wt") as out:
        out.write('{"post_id": 1, "body": "hi", "community": "x"}\nbroken {\n{"post_id": 2}\n')
    assert [r.post_id for r in readers.read_comments(spark, str(tmp_path / "c.json.gz")).collect()] == [1]
    (tmp_path / "a.json").write_text('{"article_id": 1, "cleaned_content": "t"}\n{"article_id": 2}\n')
    assert [r.article_id for r in readers.read_articles(spark, str(tmp_path / "a.json")).collect()] == [1]
    line = '{"author": "a", "num_actions_total": 9, "start_index": 1, "episode_length": 2}\n'
    (tmp_path / "s.json").write_text(line)
    assert tuple(readers.read_sample_spec(spark, str(tmp_path / "s.json")).first()) == ("a", 9, 1, 2)
    (tmp_path / "d.json").write_text(line * 2)
    with pytest.raises(Exception, match="two sample lines"):
        readers.read_sample_spec(spark, str(tmp_path / "d.json")).collect()


def test_record_shards(spark, tmp_path):
    rows = spark.range(25).coalesce(1).select(
        F.col("id").alias("author_id"), F.lit(1).cast("bigint").alias("num_posts"), F.array(F.lit(1)).alias("hour"),
        F.array(F.lit(1)).alias("action_type"), F.array(F.lit(1)).alias("lens"), F.array(F.lit(1)).alias("syms"),
        F.lit("x").alias("extra"))
    path = str(tmp_path / "r")
    writers.write_records(rows, path, FeatureConfig(), shard_rows=10)
    assert len(glob.glob(path + "/part-*")) == 3
    assert "extra" not in readers.read_records(spark, path).columns and readers.read_records(spark, path).count() == 25
    with pytest.raises(Exception, match="already exists"):
        writers.write_records(rows, path, FeatureConfig())


def test_existing_outputs_are_kept(spark, tmp_path):
    path = str(tmp_path / "d")
    writers.write_dimension(spark.range(3), path)
    writers.write_dimension(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_metric_lines(spark, tmp_path):
    row = spark.createDataFrame([(0.5, 3)], "mrr double, n bigint")
    writers.write_metrics(row, str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["mrr 0.5", "n 3.0"]


def test_a_stream_of_comments_gives_the_batch_result(spark, tmp_path):
    lines = ['{"post_id": 1, "body": "good text\\nhere", "community": "c  "}', '{"post_id": 2, "body": "12345", "community": "d"}',
             '{"post_id": 3, "body": "moretext", "community": "e"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    stream = prepare_posts(read_comment_stream(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("prepared").outputMode("append").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    got = {(r.post_id, r.body, r.community) for r in spark.table("prepared").collect()}
    assert got == {(1, "good text here", "c"), (3, "moretext", "e")}
    batch = corpus_lines(readers.read_comments(spark, str(tmp_path / "in")))
    assert {r.post_id for r in batch.collect()} == {1, 3}


def small_tables(spark, folder, posts=120, texts=7):
    """Events of six authors, one of them null, and a few documents."""
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=37 * (i % 50)), None if i % 6 == 5 else i % 6, "abcd"[i % 4], 0.5, "") for i in range(posts)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    documents = [(i, " ".join(f"w{j}" for j in range(i * 3)) if i else None) for i in range(texts)]
    spark.createDataFrame(documents, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_histories_come_in_parts(spark, tmp_path, monkeypatch):
    """Parts are bounded by the posts and the texts, share no author and make the rows of one whole."""
    sf = small_tables(spark, tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(inputs.histories(spark, sf))
    assert [rows(part) for part in inputs.history_parts(spark, sf)] == [whole]
    monkeypatch.setattr(inputs, "PART_POSTS", 40)
    parts = [rows(part) for part in inputs.history_parts(spark, sf)]
    assert len(parts) == 3 and sorted(x for part in parts for x in part) == whole
    monkeypatch.setattr(inputs, "PART_TEXTS", 17)
    assert len(list(inputs.history_parts(spark, sf))) == 1
    monkeypatch.setattr(inputs, "PART_TEXTS", 1)
    path = str(tmp_path / "written")
    writers.write_histories(inputs.history_parts(spark, sf), path)
    back = readers.read_histories(spark, path)
    assert rows(back) == rows(spark.createDataFrame(inputs.histories(spark, sf).collect(), back.schema))
    writers.write_histories(inputs.history_parts(spark, sf), path)
    assert back.count() == len(whole)


def test_shuffles_of_a_part_are_gone(spark, tmp_path):
    """While the next part is made, no shuffle file of the one before is left."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(str(f)) for f in local.getAllFiles().mkString("\n").split("\n") if "shuffle" in str(f) and os.path.exists(f))
    before, seen = held(), []

    def parts():
        for i in range(3):
            seen.append(held() - before)
            item = F.struct(F.col("id").cast("int").alias("id"))
            rows = spark.range(20_000).repartition(3).groupBy((F.col("id") % 10 + 10 * i).alias("author_id")).agg(F.collect_list(item).alias("items"))
            yield rows.select("author_id", F.lit(0).cast("bigint").alias("segment"), F.col("items.id").alias("hour"))

    key, path = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", str(tmp_path / "h")
    kept = spark.conf.get(key)
    writers.write_histories(parts(), path)
    assert max(seen) <= 0 and spark.conf.get(key) == kept
    assert readers.read_histories(spark, path).select(F.sum(F.size("hour"))).first()[0] == 60_000

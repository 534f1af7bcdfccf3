import pytest
from pyspark.sql import functions as F

from inkprint.operators import history, records, vocab

POSTS = "post_id bigint, author string, created_utc bigint, community string"


def post_rows(spark, rows):
    return spark.createDataFrame(rows, "author_id bigint, pos bigint, syms array<int>, hour int, minute int, day int, action_id int")


def test_timeline_with_one_author_holding_most_posts(spark):
    rows = [(i, "hot" if i % 4 else f"a{i % 8}", (i * 977) % 50_000, "c") for i in range(800)]
    got = history.timeline(spark.createDataFrame(rows, POSTS)).collect()
    for author in {r[1] for r in rows}:
        order = sorted((t, i) for i, a, t, _ in rows if a == author)
        assert {r.post_id: r.pos for r in got if r.author == author} == {i: n for n, (_, i) in enumerate(order)}


def test_assemble_keeps_order_empties_and_splits_long_histories(spark):
    posts = post_rows(spark, [(1, p, [p], p % 24, 0, 0, 2) for p in reversed(range(10))])
    authors = spark.createDataFrame([(1,), (2,)], "author_id bigint")
    whole = {(r.author_id, r.segment): r for r in history.assemble_history(posts, authors).collect()}
    assert whole[(1, 0)].syms == [[p] for p in range(10)] and whole[(1, 0)].action_type == [2] * 10
    assert whole[(2, 0)].syms == [] and whole[(2, 0)].hour == []
    parts = {(r.author_id, r.segment): r.hour for r in history.assemble_history(posts, authors, segment_posts=4).collect()}
    assert parts == {(1, 0): [0, 1, 2, 3], (1, 1): [4, 5, 6, 7], (1, 2): [8, 9], (2, 0): []}


def test_lookup_action(spark):
    actions = spark.createDataFrame([("a", 0), ("<unk>", 1)], "action string, action_id bigint")
    posts = spark.createDataFrame([("a",), ("zzz",)], "community string")
    assert {r.community: r.action_id for r in history.lookup_action(posts, actions).collect()} == {"a": 0, "zzz": 1}
    with pytest.raises(ValueError, match="no <unk>"):
        history.lookup_action(posts, actions.where("action = 'a'"))


def test_action_vocab(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 7), ("c", 5), ("d", 1)], "action string, n bigint")
    got = {r.action: r.action_id for r in vocab.action_vocab(counts, 4).collect()}
    assert got == {"b": 0, "a": 1, "c": 2, "<unk>": 3}
    with pytest.raises(ValueError, match="only 5 exist"):
        vocab.action_vocab(counts, 9)
    with pytest.raises(ValueError, match="reserved"):
        vocab.action_vocab(counts.union(spark.createDataFrame([("<unk>", 1)], counts.schema)), 3)


def test_missing_posts_heldout_and_spec(spark):
    posts = spark.createDataFrame([(i, "a", i, "c") for i in range(6)], POSTS)
    ids = spark.createDataFrame([(1,), (99,)], "post_id bigint")
    assert [r.post_id for r in history.missing_posts(ids, posts).collect()] == [99]
    assert history.exclude_heldout(posts, ids).count() == 5
    placed = history.timeline(posts)
    spec = spark.createDataFrame([("a", 6, 2, 3)], "author string, num_actions_total bigint, start_index bigint, episode_length bigint")
    assert sorted(r.pos for r in history.join_sample_spec(placed, spec).collect()) == [2, 3, 4]
    assert history.sample_spec_violations(posts, spec).count() == 0
    assert history.sample_spec_violations(posts, spec.withColumn("start_index", F.lit(4).cast("bigint"))).count() == 1
    assert history.sample_spec_violations(posts, spec.withColumn("num_actions_total", F.lit(7).cast("bigint"))).count() == 1


def test_authors_in_many_files(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "author string")
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    rows.where("author = 'a'").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    found = history.authors_in_many_files(spark.read.parquet(str(tmp_path / "p")))
    assert [r.author for r in found.collect()] == ["a"]


def test_ragged_records(spark):
    hist = spark.createDataFrame(
        [(1, [list(range(40)), [], [7]], [1, 2, 3], [0, 0, 0], [0, 0, 0], [1, 1, 1]), (2, [], [], [], [], [])],
        "author_id bigint, syms array<array<int>>, hour array<int>, minute array<int>, day array<int>, action_type array<int>")
    row = records.ragged_features(hist, 32).where("author_id = 1").first()
    assert row.lens == [32, 0, 1] and row.num_posts == 3 and row.syms == list(range(32)) + [7]
    assert records.ragged_features(hist).where("author_id = 1").first().lens == [40, 0, 1]
    with pytest.raises(Exception, match="more than 32"):
        records.pad_posts(records.ragged_features(hist)).collect()
    dense = records.pad_posts(records.ragged_features(hist, 32)).where("author_id = 1").first().syms
    assert [len(r) for r in dense] == [32, 32, 32] and dense[1] == [0] * 32
    assert tuple(records.history_violations(hist).first()) == (2, 1, 1)
    assert tuple(records.record_violations(records.ragged_features(hist)).first()) == (2, 0, 0)


def test_feature_config(tmp_path):
    config = records.FeatureConfig()
    config.to_json(str(tmp_path / "c.json"))
    assert records.FeatureConfig.from_json(str(tmp_path / "c.json")) == config
    with pytest.raises(ValueError, match="unknown feature"):
        records.FeatureConfig(sequence_features=["smell"])


def long_history(spark, n=1100):
    rows = [(1, p, 5000 + p, [p], p % 24, 0, 0, 0) for p in range(n)] + [(2, p, 9000 + p, [p], 0, 0, 0, 0) for p in range(3)]
    return spark.createDataFrame(
        rows, "author_id bigint, pos bigint, post_id bigint, syms array<int>, hour int, minute int, day int, action_id int")


def test_positions_close_up_after_removal(spark):
    """Slices of a long history find all their posts, whatever was removed before."""
    from inkprint.operators import episodes

    kept = history.renumber(long_history(spark).where("author_id = 2 or pos % 40 <> 7 or pos >= 960"), "author_id")
    assert [r.pos for r in kept.where("author_id = 1").orderBy("pos").collect()] == list(range(1076))
    nested = history.assemble_history(kept, kept.select("author_id").distinct())
    for start in (995, 1000, 1010):
        spec = spark.createDataFrame([(1, start, 16)], "author_id bigint, start bigint, length bigint")
        assert len(episodes.slice_histories(nested, spec).first().syms) == 16
    assert records.history_violations(nested).first().n_rows == 2
    chosen = records.select_features(records.ragged_features(nested), records.FeatureConfig())
    parts = chosen.where("author_id = 1").orderBy("segment").collect()
    assert [p.num_posts for p in parts] == [1024, 52] and sum((p.syms for p in parts), [])[:7] == list(range(7))


def test_id_lines_keep_the_order_of_long_histories(spark, tmp_path):
    from inkprint.sources import readers, writers

    posts = long_history(spark).select(F.col("author_id").cast("string").alias("author"), "pos", "post_id")
    writers.write_lines(history.id_lines(posts, 100), str(tmp_path / "ids"))
    got = readers.read_id_lists(spark, str(tmp_path / "ids")).collect()
    want = [(5000 if r.author == "1" else 9000, r.pos, r.post_id) for r in posts.collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_packed_symbols_give_the_same_histories(spark):
    """Order, a post without symbols, one without text, ids up to 65,535, equal positions and an author without posts."""
    from inkprint.functions import arrays

    rows = [(1, p, [p, 65535, 55296 + p], p % 24, 0, 0, 2) for p in reversed(range(10))]
    rows += [(1, 10, [], 1, 1, 1, 1), (1, 11, None, 1, 1, 1, 1), (3, 0, [7, 300], 1, 1, 1, 1), (3, 0, [7], 1, 1, 1, 1)]
    authors = spark.createDataFrame([(1,), (2,), (3,)], "author_id bigint")
    plain = post_rows(spark, rows)
    packed = plain.withColumn("packed", arrays.packed("syms")).drop("syms")
    for size in (4, 1024):
        want, got = (history.assemble_history(p, authors, segment_posts=size) for p in (plain, packed))
        assert sorted(want.collect()) == sorted(got.select(want.columns).collect())
    hours = history.assemble_history(plain.select("author_id", "pos", "hour"), authors)
    assert hours.columns == ["author_id", "segment", "hour"] and hours.count() == 3


def test_index_and_slices_read_no_symbols(spark):
    """The histories of these queries are nested without the symbols of the posts, and nothing is written for them."""
    import __spark_entry__ as entry

    for name in ("zip_episode_index", "slice_episode", "gather_posts"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "syms" not in plan and "packed" not in plan and "regexp_extract_all" not in plan, name

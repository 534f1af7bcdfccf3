import pytest
from pyspark.sql import functions as F

from inkprint.operators import episodes


def counts(spark, sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "author_id bigint, n bigint")


def posts(spark, sizes):
    rows = [(a, p, [a, p], p % 24, 0, 0, 1) for a, n in enumerate(sizes) for p in range(n)]
    return spark.createDataFrame(rows, "author_id bigint, pos bigint, syms array<int>, hour int, minute int, day int, action_id int")


def test_contiguous_edges(spark):
    """A history of exactly the episode length starts at 0; a shorter one is reported and left out."""
    samples = episodes.draw_samples(counts(spark, [16, 15, 40]), "s", samples=3)
    spec = episodes.contiguous_spec(samples, "s", drop_short=True).collect()
    with pytest.raises(Exception, match="too few posts for a draw of author 1"):
        episodes.contiguous_spec(samples, "s").collect()
    assert {r.start for r in spec if r.author_id == 0} == {0}
    assert not [r for r in spec if r.author_id == 1]
    assert all(0 <= r.start <= 24 for r in spec if r.author_id == 2)
    assert {r.author_id for r in episodes.short_histories(samples).collect()} == {1}


def test_nested_episodes_are_slices(spark):
    sizes = [20, 16, 50]
    spec = episodes.contiguous_spec(episodes.draw_samples(counts(spark, sizes), "s", 2), "s")
    nested = episodes.nest_episodes(episodes.episode_posts(episodes.spec_positions(spec), posts(spark, sizes))).collect()
    starts = {(r.author_id, r.sample_no): r.start for r in spec.collect()}
    assert len(nested) == 6
    for r in nested:
        start = starts[(r.author_id, r.sample_no)]
        assert r.syms == [[r.author_id, p] for p in range(start, start + 16)] and r.num_posts == 16


def test_random_episode_of_a_short_history_has_its_true_size(spark):
    positions = episodes.random_positions(episodes.draw_samples(counts(spark, [5, 30]), "r"), "r")
    nested = episodes.nest_episodes(episodes.episode_posts(positions, posts(spark, [5, 30]))).collect()
    assert {r.author_id: r.num_posts for r in nested} == {0: 5, 1: 16}


def test_draws_do_not_depend_on_partitions(spark):
    a = episodes.contiguous_spec(episodes.draw_samples(counts(spark, [40] * 50), "s", 2), "s")
    b = episodes.contiguous_spec(episodes.draw_samples(counts(spark, [40] * 50).repartition(7), "s", 2), "s")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_pairs(spark):
    samples = episodes.contiguous_spec(episodes.draw_samples(counts(spark, [30] * 25), "p", 3), "p")
    got = episodes.labelled_pairs(samples, "p").collect()
    same = [r for r in got if r.is_same]
    other = [r for r in got if not r.is_same]
    assert len(same) == 25 and all(r.left.author_id == r.right.author_id for r in same)
    assert all((r.left.sample_no, r.right.sample_no) == (0, 1) for r in same)
    assert sorted(r.left.author_id for r in other) == list(range(25)) == sorted(r.right.author_id for r in other)
    assert all(r.left.author_id != r.right.author_id for r in other)


def test_one_author_gives_no_negative_pair(spark):
    samples = episodes.contiguous_spec(episodes.draw_samples(counts(spark, [30]), "p", 3), "p")
    assert episodes.negative_pairs(samples, "p").count() == 0


def test_filters_and_takes(spark):
    c = counts(spark, [1, 2, 3, 4])
    assert episodes.filter_authors(c, 2).count() == 2
    assert episodes.filter_num_posts(c, 2).count() == 2
    with pytest.raises(ValueError):
        episodes.filter_num_posts(c, 1)
    assert sorted(r.author_id for r in episodes.take_queries(c, 3).collect()) == [0, 1, 2]
    assert episodes.take_queries(c, -1).count() == 4
    assert episodes.repeat_epochs(c, 3).count() == 12
    drawn = [r.draw for r in episodes.shuffle_records(c, "s", "author_id").collect()]
    assert drawn == sorted(drawn)


def test_slices_and_picks_cross_segments(spark):
    """A long history nested in several rows gives the same episodes as one row."""
    from inkprint.operators.history import assemble_history

    authors = spark.createDataFrame([(0,), (1,)], "author_id bigint")
    spec = spark.createDataFrame([(0, 3, 7), (1, 0, 2)], "author_id bigint, start bigint, length bigint")
    picks = spark.createDataFrame([(0, [1, 4, 11]), (1, [4])], "author_id bigint, idx array<bigint>")
    for size in (4, 100):
        nested = assemble_history(posts(spark, [12, 5]), authors, segment_posts=size)
        cut = {r.author_id: r.hour for r in episodes.slice_histories(nested, spec, size).collect()}
        assert cut == {0: list(range(3, 10)), 1: [0, 1]}
        got = {r.author_id: r.syms for r in episodes.gather_histories(nested, picks, size).collect()}
        assert got == {0: [[0, 1], [0, 4], [0, 11]], 1: [[1, 4]]}


def test_opened_positions_are_never_broadcast(spark):
    """Few authors open to many positions: neither side of the join is collected on the driver."""
    members = episodes.episode_posts(episodes.spec_positions(
        episodes.contiguous_spec(episodes.draw_samples(counts(spark, [20, 30]), "s", 8), "s")), posts(spark, [20, 30]))
    assert members.count() == 2 * 8 * 16
    assert "Broadcast" not in members._jdf.queryExecution().executedPlan().toString()


def test_episodes_by_numbers_of_symbols(spark):
    spec = episodes.contiguous_spec(episodes.draw_samples(counts(spark, [20]), "s"), "s")
    numbered = posts(spark, [20]).withColumn("n_syms", F.size("syms")).drop("syms")
    row = episodes.nest_episodes(episodes.episode_posts(episodes.spec_positions(spec), numbered)).first()
    assert row.num_posts == 16 and row.n_syms == [2] * 16

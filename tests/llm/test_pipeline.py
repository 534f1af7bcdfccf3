"""The stages of the pipeline on a small table, and the queries against their twins."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from inkprint.llm import queries

DATA = "/root/testdata/sf0.001"


def twin(name, spark):
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, DATA).select(*columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    got, want = twin(name, spark)
    assert got == want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([
        (None, None, None, None, None), (9001, "", "en", None, 0), (9002, "?? 12", "en", "src1", 5), (None, "the and of", None, "s", 10),
        (9003, docs.first().text, "en", "src0", 1), (9003, docs.first().text, "en", "src0", 1)], docs.schema)
    rows = docs.unionByName(extra)
    for column in ("score", "key", "bucket", "id", "kept", "c0"):
        rows = rows.withColumn(column, rows.doc_id % 3)
    columns, sizes = rows.columns, []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        sizes.append(rows.count())
        assert name == "pack_sequences" or rows.columns == columns
    assert 0 < sizes[1] < sizes[0] < docs.count() + 6 and sizes[1] == sizes[2] and sizes[4] > 0


def test_stages_of_nothing(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
    assert rows.count() == 0

import os

import pyarrow as pa

from tarn.llm import common

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_follow_the_operator_and_the_session(spark):
    before = spark.conf.get(KEY)
    common._batches.clear()
    spark.conf.set(KEY, "1000")
    for rows, wanted in ((16, 16), (256, 256), (5000, 1000)):
        common.bound_batches(spark, rows)
        assert spark.conf.get(KEY) == str(wanted)
    spark.conf.set(KEY, "100")
    common.bound_batches(spark, 256)
    assert spark.conf.get(KEY) == "100"
    spark.conf.set(KEY, before)


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    common.bound_batches(spark)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)
    long = spark.range(100).coalesce(1).selectExpr("repeat('x', 2000000) AS t")
    assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) <= common.BATCH_BYTES / 2_000_000 + 1


def test_free_names():
    assert common.free_name(["A", "a_"], "a") == "a__" and common.free_name([], "a") == "a"


def test_written_tables_keep_schema_without_rows(spark):
    df = spark.range(0).selectExpr("id", "cast(null AS string) AS s")
    again = common.written(df, "none")
    assert again.schema.simpleString() == df.schema.simpleString() and again.count() == 0


def test_vocabulary_folder_is_a_parameter(monkeypatch):
    monkeypatch.setenv("TARN_TOKENIZERS", "/elsewhere")
    assert common.vocabulary("x.json") == os.path.join("/elsewhere", "x.json")

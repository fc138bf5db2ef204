import os

from scoreline.llm.graph import salted_join
from scoreline.llm.storage import WHILE_WRITTEN, release, saved


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_settings_are_as_before_and_tables_go_when_released(spark, tmp_out):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITTEN}
    spark.conf.set(key, "77")
    try:
        df = saved(spark.range(10).groupBy("id").count(), "one")
        assert spark.conf.get(key) == "77" and all(spark.conf.get(k, None) == v for k, v in before.items() if k != key)
    finally:
        spark.conf.unset(key)
    other = saved(df, "other")
    assert df.count() == 10 and os.path.exists(folder(df))
    path = folder(df)
    release(df)
    assert not os.path.exists(path) and other.count() == 10
    # what this module didn't write stays
    spark.range(3).write.parquet(f"{tmp_out}/llm-mine")
    mine = spark.read.parquet(f"{tmp_out}/llm-mine")
    release(mine)
    assert mine.count() == 3


def test_salted_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(60)] + [(99, "nowhere"), (100, None)], "i long, k string")
    names = spark.createDataFrame([("hot", 1), *((f"k{j}", j + 2) for j in range(7))], "k string, v int")
    for how in ("inner", "left"):
        plain = sorted((tuple(r) for r in rows.join(names, "k", how).select("i", "k", "v").collect()), key=repr)
        assert sorted((tuple(r) for r in salted_join(rows, names, "k", how).select("i", "k", "v").collect()), key=repr) == plain

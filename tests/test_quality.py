"""Not-null, uniqueness and lookup-coverage checks on dirty frames."""

from scoreline.operators.quality import lookup_coverage, not_null_report, unique_report
from scoreline.sources.dims import dim_frame


def test_not_null_report(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "k int, v string")
    r = {x.column: x for x in not_null_report(df, "t", ["k", "v"]).collect()}
    assert (r["k"].rows, r["k"].null_rows, r["k"].passed) == (3, 2, False)
    assert (r["v"].null_rows, r["v"].passed) == (1, False)
    assert not_null_report(spark.createDataFrame([], "k int"), "e", ["k"]).first().passed


def test_unique_report(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    r = unique_report(df, "t", ["k"]).first()
    assert (r.duplicate_keys, r.duplicate_rows, r.passed) == (1, 2, False)  # NULLs not checked
    assert unique_report(spark.createDataFrame([(1,), (2,)], "k int"), "t", ["k"]).first().passed


def test_lookup_coverage_and_case_fan_out(spark):
    dim = dim_frame(spark, {"Brazil": "CONMEBOL", "brazil": "x"})
    df = spark.createDataFrame([("Brazil",), ("Fiji",), ("Fiji",), (None,)], "n string")
    r = lookup_coverage(df, "n", dim, "key", "conf").first()
    assert (r.keys, r.unmapped_keys) == (2, 1)


def test_lookup_join_defaults_and_fan_out(spark):
    from pyspark.sql import functions as F

    from scoreline.operators.analytics import filter_in
    from scoreline.sources.dims import lookup
    dim = dim_frame(spark, {"Brazil": "CONMEBOL", "Chile": "CONMEBOL"})
    df = spark.createDataFrame([("Brazil",), ("Fiji",)], "n string")
    r = {x.n: x.c for x in lookup(df, "n", dim, "c", default="Outro").collect()}
    assert r == {"Brazil": "CONMEBOL", "Fiji": "Outro"}
    r = {x.n: x.c for x in lookup(df, "n", dim, "c", default=F.col("n")).collect()}
    assert r == {"Brazil": "CONMEBOL", "Fiji": "Fiji"}
    # a case-insensitive key over two spellings fans out (the mart's unique test guards it)
    two = dim_frame(spark, {"Brazil": "x", "BRAZIL": "y"}).select(F.lower("key").alias("key"), "value")
    assert lookup(df, F.lower("n"), two, "c", bounded=False).where("n = 'Brazil'").count() == 2
    assert filter_in(df, "n", []).count() == 2 and filter_in(df, "n", ["Fiji"]).count() == 1


def test_entry_in_fresh_process():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print(E.entry(s).count())\n") % root
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "27"

"""Two-phase replacement of tables, write-back of the cache, writes that count on the way,
isolated sources, partition-wise rebuilds, shared frames."""

import json
import os
import subprocess
import sys
import threading

import pytest

from scoreline.operators.photos import write_back
from scoreline.plans.models import MODELS, PARTITIONED, build_order, read_model, rebuild_editions, run_models, standin_bronze
from scoreline.sources import versions as V
from scoreline.sources.ingest import ingest_sources, ingested
from scoreline.sources.io import read_csv, read_kv_json, replace_if_rows, replace_table, table_or_fallback
from scoreline.sources.memo import memo, shared

from .conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def entries(spark, path):
    return {r.name: r.url for r in read_kv_json(spark, path).collect()}


def cache(spark, **names):
    return spark.createDataFrame(list(names.items()), "name string, url string")


def test_cache_is_merged_twice_into_one_path(spark, tmp_out):
    p = f"{tmp_out}/cache"
    assert write_back(cache(spark, a="1", b=""), p) == 1
    assert write_back(cache(spark, b="2", c="3"), p) == 2
    assert entries(spark, p) == {"a": "1", "b": "2", "c": "3"}


def test_failure_between_the_phases_loses_no_entry(spark, tmp_out, monkeypatch):
    p = f"{tmp_out}/cache"
    write_back(cache(spark, a="1"), p)

    def lost(*_):
        raise RuntimeError("lost before the swap")

    with monkeypatch.context() as m:
        m.setattr(V, "swap", lost)
        with pytest.raises(RuntimeError, match="lost before"):
            write_back(cache(spark, b="2"), p)
    assert entries(spark, p) == {"a": "1"}
    write_back(cache(spark, b="2"), p)
    write_back(cache(spark, c="3"), p)
    assert entries(spark, p) == {"a": "1", "b": "2", "c": "3"}
    assert V.versions(spark, p) == [1, 2, 3]


def test_failure_while_rows_are_written_keeps_the_old_version(spark, tmp_out):
    p = f"{tmp_out}/t"
    replace_table(spark.range(3), p)
    with pytest.raises(Exception, match="(?i)bad row"):
        replace_table(spark.range(10).selectExpr("if(id = 7, raise_error('bad row'), id) AS id"), p)
    assert V.read_current(spark, p).count() == 3


def test_overtaken_writer_merges_again(spark, tmp_out):
    p, calls = f"{tmp_out}/cache", []
    write_back(cache(spark, a="1"), p)

    def change(old):
        if not calls:
            write_back(cache(spark, other="x"), p)  # another writer comes first
        calls.append(1)
        return old.unionByName(cache(spark, mine="y"))

    V.update_table(spark, p, change, "json")
    assert len(calls) == 2 and entries(spark, p) == {"a": "1", "other": "x", "mine": "y"}


def test_one_version_number_is_taken_once(spark, tmp_out):
    p = f"{tmp_out}/t"
    one, two = V.stage(spark.range(1), p), V.stage(spark.range(2), p)
    V.swap(spark, one)
    with pytest.raises(V.Conflict):
        V.swap(spark, two)
    assert V.read_current(spark, p).count() == 1


def test_concurrent_writers_lose_nothing(spark, tmp_out):
    p, errors = f"{tmp_out}/cache", []

    def work(name):
        try:
            V.update_table(spark, p, lambda old: cache(spark, **{name: "1"}) if old is None else old.unionByName(cache(spark, **{name: "1"})), "json", attempts=12)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(f"n{i}",)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and set(entries(spark, p)) == {f"n{i}" for i in range(4)}


def test_reader_that_started_before_the_swap_ends_right(spark, tmp_out):
    p = f"{tmp_out}/t"
    replace_table(spark.range(0, 1000, 1, 4), p)
    started = V.read_current(spark, p)
    rows = started.toLocalIterator()
    first = next(rows)
    replace_table(spark.range(5), p)
    assert len([first, *rows]) == 1000 and started.agg({"id": "max"}).first()[0] == 999
    assert V.read_current(spark, p).count() == 5
    assert V.read_current(spark, p, version=1).count() == 1000


def test_vacuum_keeps_the_last_versions(spark, tmp_out):
    p = f"{tmp_out}/t"
    for n in (1, 2, 3):
        replace_table(spark.range(n), p)
    assert V.vacuum(spark, p, keep=2) == [1] and V.versions(spark, p) == [2, 3]
    assert len(os.listdir(f"{p}.data")) == 2
    assert V.read_current(spark, p).count() == 3
    replace_table(spark.range(9), p)
    assert V.versions(spark, p) == [2, 3, 4] and table_or_fallback(spark, p, lambda: spark.range(1)).count() == 9


def test_no_rows_leave_the_old_table_and_no_folder(spark, tmp_out):
    p = f"{tmp_out}/t"
    replace_table(spark.range(3), p)
    assert not replace_if_rows(spark.range(0), p) and not replace_if_rows(spark.range(9).where("id < 0"), p)
    assert not replace_if_rows(spark.createDataFrame([], "id long"), p)
    assert V.read_current(spark, p).count() == 3 and len(os.listdir(f"{p}.data")) == 1
    assert not replace_if_rows(spark.range(0), f"{tmp_out}/never") and V.versions(spark, f"{tmp_out}/never") == []


SCAN = """
import sys
from pyspark.sql import functions as F
from scoreline.session import build_session
from scoreline.sources.io import replace_if_rows
spark = build_session("local[2]", 2, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + sys.argv[1], "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
df = spark.read.parquet(sys.argv[2]).where("id % 2 = 0").groupBy((F.col("id") % 10).alias("k")).count()
assert replace_if_rows(df, sys.argv[3])
spark.stop()
"""


def test_event_log_shows_one_scan_of_the_input(spark, tmp_out):
    spark.range(0, 4000, 1, 4).write.parquet(f"{tmp_out}/in")
    os.makedirs(f"{tmp_out}/log")
    subprocess.run([sys.executable, "-c", SCAN, f"{tmp_out}/log", f"{tmp_out}/in", f"{tmp_out}/out"], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, timeout=300)
    read = 0
    for name in os.listdir(f"{tmp_out}/log"):
        for line in open(f"{tmp_out}/log/{name}"):
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd":
                read += event["Task Metrics"]["Input Metrics"]["Records Read"]
    assert read == 4000
    assert V.read_current(spark, f"{tmp_out}/out").count() == 5


def test_sources_fail_on_their_own(spark, tmp_out):
    good, bad = f"{tmp_out}/good.csv", f"{tmp_out}/bad.csv"
    open(good, "w").write("year,winner\n1930,Uruguay\n1934,Italy\n")
    open(bad, "w").write("year,winner\n1930,Uruguay\nx,y\nz\n")
    csv = lambda p: lambda: read_csv(spark, p, "year int, winner string")
    sources = {
        "cups": csv(good), "missing": csv(f"{tmp_out}/nowhere.csv"), "rough": csv(bad), "broken": lambda: spark.range(3).selectExpr("raise_error('no') AS year"),
        "none": lambda: spark.createDataFrame([], "year int"), "raises": lambda: 1 / 0,
    }
    report = {r.source: r for r in ingest_sources(spark, sources, f"{tmp_out}/bronze").collect()}
    assert {n: (r.status, r.rows, r.rejected_rows) for n, r in report.items()} == {
        "cups": ("read", 2, 0), "missing": ("failed", 0, 0), "rough": ("rejected", 3, 2), "broken": ("failed", 0, 0), "none": ("empty", 0, 0), "raises": ("failed", 0, 0)}
    assert report["missing"].error == "PATH_NOT_FOUND" and report["raises"].error == "ZeroDivisionError" and report["broken"].error
    assert [tuple(r) for r in ingested(spark, f"{tmp_out}/bronze", "rough").collect()] == [(1930, "Uruguay")]
    assert ingested(spark, f"{tmp_out}/bronze", "cups").count() == 2
    assert sorted(tuple(r) for r in V.read_current(spark, f"{tmp_out}/bronze/quarantine").collect()) == [("rough", "x,y"), ("rough", "z")]
    for name in ("missing", "broken", "none", "raises"):
        assert V.versions(spark, f"{tmp_out}/bronze/{name}") == []
    # a later load without rows keeps the table, and the quarantine is that of the last load
    ingest_sources(spark, {"cups": sources["none"]}, f"{tmp_out}/bronze")
    assert ingested(spark, f"{tmp_out}/bronze", "cups").count() == 2
    assert V.read_current(spark, f"{tmp_out}/bronze/quarantine").count() == 0


def test_order_follows_the_declared_inputs():
    order = build_order(dict(reversed(MODELS.items())))
    for name, (inputs, _) in MODELS.items():
        assert all(order.index(i) < order.index(name) for i in inputs if i in MODELS)
    with pytest.raises(ValueError, match="need each other: (a -> b|b -> a)"):
        build_order({"a": (["b"], None), "b": (["a"], None)})
    with pytest.raises(ValueError, match=r"model a needs \['x'\]"):
        build_order({"a": (["x"], None)}, {"y"})


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_one_changed_edition_rewrites_one_partition(spark, tmp_out):
    bronze = standin_bronze(spark, SF_SMALL)
    bronze["matches"].write.parquet(f"{tmp_out}/matches")
    bronze["matches"] = spark.read.parquet(f"{tmp_out}/matches")
    paths = run_models(spark, bronze, f"{tmp_out}/models")
    before = {n: files(paths[n]) for n in PARTITIONED}
    year = 1995
    changed = {**bronze, "matches": bronze["matches"].selectExpr("* EXCEPT (home_team_goals)", f"if(year = {year}, 0, home_team_goals) AS home_team_goals")}
    written = rebuild_editions(spark, changed, f"{tmp_out}/models", [year])
    assert written == [m for m in build_order() if m in ("stg_matches", "stg_nations", "mart_nations_performance", "mart_edition_history")]
    for name in PARTITIONED:
        after = files(paths[name])
        same = {f for f in before[name] if after.get(f) == before[name][f]}
        assert same == {f for f in before[name] if f"edition_year={year}" not in f} and len(same) < len(after)
    full = run_models(spark, changed, f"{tmp_out}/full")
    for name in written:
        a, b = (read_model(spark, p[name]) for p in (paths, full))
        cols = sorted(a.columns)
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
    # an edition that has gone takes its partition with it
    gone = {**bronze, "matches": changed["matches"].where(f"year <> {year}")}
    rebuild_editions(spark, gone, f"{tmp_out}/models", [year])
    assert not os.path.exists(f"{paths['stg_matches']}/edition_year={year}")
    assert read_model(spark, paths["mart_edition_history"]).where(f"edition_year = {year}").count() == 0


def test_frames_of_a_scope_are_read_once_and_freed(spark, tmp_out):
    import shutil

    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    spark.range(100).write.parquet(f"{tmp_out}/in")
    before = held()
    load = lambda: spark.read.parquet(f"{tmp_out}/in").where("id % 2 = 0")
    with memo(spark) as scope:
        first = shared(load())
        assert first.count() == 50
        second = shared(load())
        assert len(scope.frames) == 1
        with memo(spark):
            assert shared(load()) is first
            shared(spark.range(3)).count()
            assert held() == before + 2
        assert held() == before + 1
        shutil.rmtree(f"{tmp_out}/in")  # the second query can only read what the first one left
        assert second.selectExpr("sum(id)").first()[0] == 2450
    assert held() == before
    assert shared(spark.range(3)).storageLevel.useMemory is False


def test_queries_share_layers_in_a_scope(spark):
    from scoreline.plans import all_queries

    queries = all_queries()
    plain = [sorted(map(str, queries[n].build(spark, SF_SMALL).collect())) for n in ("nations_table", "ranking_topn")]
    with memo(spark) as scope:
        frames = [queries[n].build(spark, SF_SMALL) for n in ("nations_table", "ranking_topn")]
        assert [sorted(map(str, df.collect())) for df in frames] == plain
        assert scope.frames and all("InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString() for df in frames)
    assert sorted(map(str, queries["nations_table"].build(spark, SF_SMALL).collect())) == plain[0]

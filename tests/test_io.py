"""Readers and sinks on temporary files: typed CSV, header rules, GeoJSON,
key-value cache JSON, replace-table, write-if-rows, fallback."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scoreline.operators.facts import read_layouts
from scoreline.operators.photos import merge_cache, names_to_fetch, with_photo
from scoreline.sources.io import (country_rows, named_features, normalize_headers, read_csv, read_feature_collection,
                                  read_features, read_kv_json, replace_if_rows, replace_table,
                                  table_or_fallback, union_sources, with_source,
                                  write_feature_collection, write_features, write_kv_json)
from scoreline.sources.versions import read_current


def test_csv_declared_types_and_headers(spark, tmp_out):
    p = os.path.join(tmp_out, "cups.csv")
    with open(p, "w") as f:
        f.write("Year,Country,Winner,Runners-Up,Attendance\n1930,Uruguay,Uruguay,Argentina,590.549\n"
                "1934,Italy,Italy,Czechoslovakia,363.000\n")
    df = normalize_headers(read_csv(spark, p, "Year int, Country string, Winner string, "
                                              "`Runners-Up` string, Attendance string"))
    assert df.columns == ["year", "country", "winner", "runners-up", "attendance", "_corrupt_record"]
    r = df.orderBy("year").first()
    assert r.year == 1930 and r.attendance == "590.549"  # thousands text kept as text


def test_geojson_roundtrip(spark, tmp_out):
    p = os.path.join(tmp_out, "countries.geojson")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "Brazil", "ISO3166-1-Alpha-3": "BRA"}, "geometry": None},
        {"type": "Feature", "properties": {"ISO3166-1-Alpha-3": "XXX"}, "geometry": None},
        {"type": "Feature", "properties": {"name": "Chile"}, "geometry": None}]}
    with open(p, "w") as f:
        json.dump(fc, f)
    feats = read_features(spark, p, fmt="collection")
    q = spark.createDataFrame([("Brazil",)], "name string")
    rows = {r.country_name: r for r in country_rows(feats, q).collect()}
    assert rows["Brazil"].iso_a3 == "BRA" and rows["Brazil"].qualified_2026
    assert rows[""].iso_a3 == "XXX" and not rows[""].qualified_2026  # missing name -> ''
    assert rows["Chile"].iso_a3 == ""
    out = os.path.join(tmp_out, "qualified")
    write_features(named_features(feats).where(F.col("properties")["name"] == "Brazil"), out)
    back = spark.read.json(out)
    assert back.count() == 1 and back.first().type == "Feature"
    again = read_features(spark, out, fmt="lines").first()
    assert again.properties["name"] == "Brazil" and again.properties["ISO3166-1-Alpha-3"] == "BRA"


def test_kv_cache_read_merge_write(spark, tmp_out):
    p = os.path.join(tmp_out, "photos.json")
    with open(p, "w") as f:
        json.dump({"Alisson": "https://x/200px-a.jpg", "Gavi": "", "Pedri": ""}, f)
    cache = read_kv_json(spark, p, fmt="object")
    assert cache.count() == 3
    assert read_kv_json(spark, os.path.join(tmp_out, "missing.json")).count() == 0
    bad = os.path.join(tmp_out, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    assert read_kv_json(spark, bad, fmt="object").count() == 0
    players = spark.createDataFrame([("Alisson",), ("Gavi",), ("Pedri",), ("Rodri",)], "player_name string")
    over = spark.createDataFrame([("Gavi", "Gavi_(footballer)"), ("Rodri", None)], "name string, slug string")
    need = {r.name: r.slug for r in names_to_fetch(players, cache, over).collect()}
    assert need == {"Gavi": "Gavi_%28footballer%29", "Rodri": "Rodri"}  # Pedri: known miss, no override
    upd = spark.createDataFrame([("Gavi", "https://x/g.jpg"), ("Rodri", "")], "name string, url string")
    merged = {r.name: r.url for r in merge_cache(cache, upd).collect()}
    assert merged == {"Alisson": "https://x/200px-a.jpg", "Gavi": "https://x/g.jpg", "Pedri": "", "Rodri": ""}
    photos = {r.player_name: r.photo_url for r in with_photo(players, cache).collect()}
    assert photos["Alisson"] == "https://x/320px-a.jpg" and photos["Rodri"] == ""
    out = os.path.join(tmp_out, "cache_out")
    write_kv_json(merge_cache(cache, upd), out)
    back = {r.name: r.url for r in read_kv_json(spark, out, fmt="lines").collect()}
    assert back == merged  # written cache reads back whole


def test_replace_and_fallback(spark, tmp_out):
    p = os.path.join(tmp_out, "t")
    replace_table(spark.range(3), p)
    assert not replace_if_rows(spark.range(0), p)  # empty: old table kept
    assert read_current(spark, p).count() == 3
    assert replace_if_rows(spark.range(5), p)
    assert read_current(spark, p).count() == 5
    fb = table_or_fallback(spark, os.path.join(tmp_out, "nope"), lambda: spark.range(2))
    assert fb.count() == 2
    assert table_or_fallback(spark, p, lambda: spark.range(2)).count() == 5


def test_sources_union(spark):
    a = spark.createDataFrame([("ARG", "Messi")], "nation string, player string")
    b = spark.createDataFrame([("Kane", 90.0)], "player_name string, market_value_eur_m double")
    u = union_sources([with_source(a, "Argentina"), with_source(b, "England")])
    assert u.columns[:3] == ["nation", "player_nationality", "player"]
    r = {x.nation: x for x in u.collect()}
    assert r["Argentina"].player_nationality == "ARG" and r["England"].player_nationality is None


def test_seed_csv_with_odd_column_name(spark, tmp_out):
    from scoreline.operators.cleaning import stage_players
    p = os.path.join(tmp_out, "squads.csv")
    with open(p, "w") as f:
        f.write("nation,player,pos,age,mp,gls,ast,90s\nBrazil,Alisson,GK,31-200,5,0,0,4.5\n"
                "Brazil,Raphinha,FW,27-10,x,3,2,\n")
    squads = read_csv(spark, p, "nation string, player string, pos string, age string, mp string, "
                                "gls double, ast double, `90s` double")
    market = spark.createDataFrame([("Brazil", "alisson", 30.0)], "nation string, player_name string, "
                                                                   "market_value_eur_m double")
    r = {x.player_name: x for x in stage_players(squads, market).collect()}
    assert r["Alisson"].minutes_90s == 4.5 and r["Alisson"].market_value_eur_m == 30.0
    assert r["Raphinha"].matches_played is None and r["Raphinha"].minutes_90s is None



def test_csv_keeps_and_counts_rejected_lines(spark, tmp_out):
    import pytest
    from scoreline.sources.io import CORRUPT, reject_report
    p = os.path.join(tmp_out, "bad.csv")
    with open(p, "w") as f:
        f.write("year,winner\n1930,Uruguay\nbad,x\n1934,Italy\n")
    df = read_csv(spark, p, "year int, winner string").cache()
    assert [r[CORRUPT] for r in df.collect()] == [None, "bad,x", None]
    assert reject_report(df, "cups").first()[:] == ("cups", 3, 1)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_csv(spark, p, "year int, winner string", strict=True).collect()


def test_unreadable_cache_is_not_taken_for_an_empty_one(spark, tmp_out):
    import pytest
    with pytest.raises(Exception):  # noqa: B017 - any error but "no such path"
        read_kv_json(spark, "nosuchscheme://x/cache").count()
    with pytest.raises(Exception):  # noqa: B017
        table_or_fallback(spark, "nosuchscheme://x/t", lambda: spark.range(1))


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 3), (7, 2), (200, 6)])
def test_feature_collection_is_one_document_of_ordered_parts(spark, tmp_out, n, parts):
    odd = ['plain', 'quo"te', "},{", ", comma", "], }", "line\\nfeed", "ünïcode", ""]
    rows = [({"name": f"{odd[i % 8]} {i:03d}", "k": str(i)}, [None, '{"type":"Point","coordinates":[1.5,%d]}' % i][i % 2]) for i in reversed(range(n))]
    df = spark.createDataFrame(rows, "properties map<string,string>, geometry string").repartition(parts)
    out = f"{tmp_out}/collection"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_feature_collection(df, out, [F.col("properties")["k"].cast("int")])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = sorted(f for f in os.listdir(out) if f.endswith(".txt"))
    document = json.loads("".join(open(f"{out}/{f}", encoding="utf-8").read() for f in names))
    assert document["type"] == "FeatureCollection"
    assert [(f["properties"], f["geometry"]) for f in document["features"]] == [(p, json.loads(g) if g else None) for p, g in reversed(rows)]
    back = read_feature_collection(spark, out)
    key = lambda r: int(r[0]["k"])
    assert sorted(((r.properties, json.loads(r.geometry) if r.geometry else None) for r in back.collect()), key=key) == sorted(((p, json.loads(g) if g else None) for p, g in rows), key=key)
    if n == 200:
        assert sum(f.startswith("part-") and "~" not in f for f in names) > 1  # written by several tasks
        # the whole document reads as an imported one, too
        open(f"{tmp_out}/one.geojson", "w", encoding="utf-8").write(json.dumps(document))
        assert read_features(spark, f"{tmp_out}/one.geojson", fmt="collection").count() == n


def test_layouts_by_file_group(spark, tmp_out):
    spark.createDataFrame([("a", 1, 9)], "team string, goals_for int, extra int").write.parquet(f"{tmp_out}/old")
    spark.createDataFrame([("b", 2, 7)], "team string, goals_scored int, goals_for int").write.parquet(f"{tmp_out}/new")
    spark.createDataFrame([("c", 3)], "team string, tally int").write.parquet(f"{tmp_out}/third")
    got = read_layouts(spark, {"old": [f"{tmp_out}/old"], "new": [f"{tmp_out}/new", f"{tmp_out}/new"], "third": [f"{tmp_out}/third"]}, {"goals_scored": ["goals_for", "tally"]})
    rows = sorted((r.file_group, r.team, r.goals_scored, r.extra, r.goals_for) for r in got.collect())
    assert rows == [("new", "b", 2, None, 7), ("new", "b", 2, None, 7), ("old", "a", 1, 9, None), ("third", "c", 3, None, None)]


def test_nation_without_a_record_gets_the_default_one(spark):
    from scoreline.operators.marts import nation_info
    from scoreline.sources.dims import INFO_DEFAULT
    info = spark.createDataFrame([("Brazil", "C", "CONMEBOL", 5, "22", "text", ["a", "b"])], "nation string, group string, confederation string, titles int, editions string, curiosity string, players array<string>")
    got = {r.country_name: r["info"].asDict() for r in nation_info(spark.createDataFrame([("Brazil",), ("Fiji",), (None,)], "country_name string"), info, INFO_DEFAULT).collect()}
    assert got["Brazil"] == {"group": "C", "confederation": "CONMEBOL", "titles": 5, "editions": "22", "curiosity": "text", "players": ["a", "b"]}
    assert got["Fiji"] == got[None] == INFO_DEFAULT

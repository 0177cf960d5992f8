"""Readers, sinks and test statistics."""

import datetime as dt

import pytest

from tidemark.functions import pvalues as V
from tidemark.sources import package as K
from tidemark.sources import readers as R

HEAD = "Timestamp," + ",".join(R.CHANNELS.values())


def export(path, start, hours, energy, minute=0):
    rows = [f"{dt.datetime(2024, 1, 1, 0, minute) + dt.timedelta(hours=start + h)},{energy + h},500,10,,70,50,{h}" for h in range(hours)]
    path.write_text("\n".join([HEAD, *rows]))


def test_overlapping_exports_become_one_series(spark, tmp_path):
    export(tmp_path / "17_old.csv", 0, 96, 1000)
    export(tmp_path / "17_new.csv", 48, 96, 2000, minute=3)
    (tmp_path / "notes.txt").write_text("x")
    got = R.ingest(R.exports(spark, str(tmp_path))).orderBy("ts").collect()
    assert len(got) == 144 and [r["energy"] >= 2000 for r in got] == [False] * 48 + [True] * 96
    assert {r["meter"] for r in got} == {17} and {r["dt"] for r in got} == {20.0} and all(r["ts"].minute == 0 for r in got)


def test_weather_and_local_time(spark, tmp_path):
    (tmp_path / "w.txt").write_text("STATIONS_ID;MESS_DATUM;QN_9;TT_TU;RF_TU;eor\n1;2023102900;3; 5.0;80;eor\n1;2023102901;3; 6.0;80;eor\n1;2023102902;3;-999;80;eor\n")
    w = R.weather(spark, str(tmp_path / "w.txt"))
    assert [r["t_out"] for r in w.orderBy("ts").collect()] == [5.0, 6.0, None]
    local = R.local_time(w, "ts", "Europe/Berlin").orderBy("ts").collect()
    assert [(r["ts"].hour, r["t_out"]) for r in local] == [(2, 5.0), (3, None)]


def test_packages_are_versioned_and_verified(tmp_path):
    at = K.write_package(str(tmp_path), "watch", "1", {"a.bin": b"x"}, {"h": 5})
    with pytest.raises(FileExistsError):
        K.write_package(str(tmp_path), "watch", "1", {}, {})
    K.write_package(str(tmp_path), "watch", "2", {"a.bin": b"y"}, {})
    K.set_current(str(tmp_path), "watch", "1")
    assert K.read_package(str(tmp_path), "watch")["content"] == {"a.bin": b"x"} and len(K.packages(str(tmp_path))) == 2
    (at / "a.bin").write_bytes(b"z")
    with pytest.raises(ValueError):
        K.read_package(str(tmp_path), "watch", "1")


def test_bundle_and_partitions(spark, tmp_path):
    d = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 2.0)], "meter int, ts timestamp_ntz, v double")
    K.write_meters(d, str(tmp_path / "m"))
    K.write_bundle({"t": d}, str(tmp_path / "b"), {"run": 1})
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1 and '"run": 1' in spark.read.text(str(tmp_path / "b/manifest")).first()[0]
    assert K.without_personal(d, ["v", "name"]).columns == ["v"]


def test_directory(spark):
    d = spark.createDataFrame([("a", 1, "2020"), ("a", 2, "2021"), ("b", 3, "2020"), ("b", 4, "2020"), ("c", 5, "2020")], "key string, meter int, year string")
    assert {r["key"]: r["kind"] for r in R.swaps(d).collect()} == {"a": "swap", "b": "parallel"}


def test_p_values():
    assert V.binomial_tail(8, 10, 0.5) == pytest.approx(56 / 1024)
    assert V.fisher_exact(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert V.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-7) and V.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert V.mcnemar(1, 5) == pytest.approx(14 / 64) and V.mcnemar(0, 0) == 1.0
    assert V.cliffs_delta(15 + 3, 3, 3) == pytest.approx(2 * (18 - 6) / 9 - 1)

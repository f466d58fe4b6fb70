"""Dialects of text tables, bus logs, reports."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import sweeps as W
from fleetlens.sources import dialects, telemetry
from fleetlens.sources.dialects import tell_dialect


@pytest.mark.parametrize(
    "text,want",
    [
        ("a,b,c\n1,2,3\n4,5,6\n", (",", '"', ("a", "b", "c"))),
        ("a;b\n1,5;2\n2,5;3\n", (";", '"', ("a", "b"))),
        ("id|note|x\n1|has, commas, here|2\n2|more, of, them|3\n", ("|", '"', ("id", "note", "x"))),
        ("1\t2\n3\t4\n", ("\t", '"', None)),
        ('k,v\n"a, b",1\n"c, d, e",2\n', (",", '"', ("k", "v"))),
        ("k;v\n'a; b';1\n'c';2\n", (";", "'", ("k", "v"))),
        ("2024-01-01,x,1\n2024-01-02,y,2\n", (",", '"', None)),
        ("Name , Other\nann , bob\n", (",", '"', ("name", "other"))),
        ("", (None, None, None)),
        ("alone\n1\n2\n", (None, None, ("alone",))),
    ],
)
def test_dialects(text, want):
    got = tell_dialect(text)
    assert got.header == want[2]
    if want[0]:
        assert got[:2] == want[:2]


def test_a_cut_line_does_not_count():
    assert tell_dialect("a,b,c\n1,2,3\n4,5,6\n7", whole=False)[:2] == (",", '"')


def test_files_of_different_dialects_are_one_table(spark, tmp_path):
    (tmp_path / "x").mkdir()
    files = {"1.csv": "ID, ts ,v\na,2024-01-01 00:00:01,1.5\nb,bad,2\n", "2.csv": "v;id;ts;extra\n3;'c; d';2024-01-01 00:00:02;9\n", "3.csv": "e|2024-01-01 00:00:03|x\n", "_skipped.csv": "z", "4.csv": ""}
    for name, text in files.items():
        (tmp_path / "x" / name).write_text(text)
    schema = T.StructType.fromDDL("id string, ts timestamp, v double")
    got = dialects.scan_csv_conform(spark, str(tmp_path / "x"), schema)
    assert got.schema == schema
    assert sorted((r.id, r.v) for r in got.collect()) == [("a", 1.5), ("c; d", 3.0), ("e", None)]
    assert len(dialects.files_by_dialect(spark, str(tmp_path / "x"))) == 3


def test_logs_round_trip(spark, tmp_path):
    rows = [(1000 + i // 2, i, 0x18FF50E5 + i, [i, 2, 3, 4, 5, 6, 7, 255]) for i in range(20)]
    frames = spark.createDataFrame(rows, "ts_ms long, sequence long, can_id long, bytes array<int>").orderBy(F.desc("sequence"))
    places = [7, 6, 5, 4, 3, 2, 1, 0]
    lines = [r.value for r in W.text_of_frames(frames, 1000, places).collect()]
    assert lines[:2] == ["0.000000 1 18ff50e5x Rx d 8 ff 07 06 05 04 03 02 00", "0.000000 1 18ff50e6x Rx d 8 ff 07 06 05 04 03 02 01"]
    W.write_asc_frames(frames, str(tmp_path / "log"), 1000, places)
    text = spark.read.text(str(tmp_path / "log"))
    assert text.where("value LIKE 'base hex%'").count() >= 1
    got = sorted((r.ts_ms, r.can_id, tuple(r.bytes)) for r in W.frames_of_text(text, 1000).collect())
    assert got == sorted((t, c, tuple(b[::-1])) for t, _, c, b in rows)


def test_short_frames_are_filled_with_zeros(spark):
    df = spark.createDataFrame([("0.5 1 1Ax Rx d 3 01 02 ff",), ("0.6 1 1Ax Rx d 8 01 02 03 04 05 06 07 08 trailing",), ("0.7 1 1Ax Rx d 0",), ("x 1 1A Rx d 1 00",)], "value string")
    assert [r.bytes for r in W.frames_of_text(df, 0).orderBy("ts_ms").collect()] == [[1, 2, 255, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6, 7, 8]]


def test_frames_by_bytes(spark):
    df = spark.createDataFrame([(1, [5, 7]), (1, [5]), (2, [5, 7]), (1, [6, 7]), (1, None)], "can_id long, bytes array<int>")
    assert W.search_frames(df, 1, {1: 5, 2: 7}).count() == 1
    assert [(r.can_id, r.n) for r in W.frequent_ids(df, 1, 5).collect()] == [(1, 4)]


def test_large_reports_are_written_in_parts(spark, tmp_path):
    df = spark.range(100).repartition(4)
    assert telemetry.sink_csv_report(df, str(tmp_path / "a")) == 100 and len(list((tmp_path / "a").glob("*.csv"))) == 1
    assert telemetry.sink_csv_report(df, str(tmp_path / "b"), most_rows=50) == 100 and len(list((tmp_path / "b").glob("*.csv"))) == 4
    assert spark.read.csv(str(tmp_path / "b"), header=True).count() == 100

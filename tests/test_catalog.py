"""Dumps, table copies, signal bytes and ranges, segment sweeps (also as a stream), on small inputs."""

import datetime
import random

import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.operators import signals as G
from fleetlens.operators.covers import _chunks
from fleetlens.sources import tables as B
from fleetlens.streaming import jobs

DUMP = """-- a dump
COPY public.cities (id, name, "size") FROM stdin;
1\tRome\t2.5
2\t\\N\tx
\\.
not a row
COPY public.user_accounts (id) FROM stdin;
7
\\.
COPY public.empty (id) FROM stdin;
\\.
"""


def test_dump_from_a_file(spark, tmp_path):
    (tmp_path / "d.sql").write_text(DUMP)
    rows = B.scan_dump_tables(B.scan_lines(spark, str(tmp_path / "d.sql")), skip=("user_accounts",))
    assert [r.table for r in rows.collect()] == ["cities", "cities"]
    got = B.dump_table(rows, "cities", {"id": "long", "name": "string", "country": "string"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "Rome", None), (2, None, None)]


def test_dump_markers_pass_blocks(spark):
    lines = [(n // 2, n, v) for n, v in enumerate(DUMP.splitlines())]
    df = spark.createDataFrame(lines, "block long, n long, value string").withColumn("file", F.lit("f"))
    assert sorted((r.table, r["values"][0]) for r in B.scan_dump_tables(df).collect()) == [("cities", "1"), ("cities", "2"), ("user_accounts", "7")]


def test_dump_without_tables(spark):
    df = spark.createDataFrame([("f", 0, 0, "x"), ("f", 1, 1, None)], "file string, block long, n long, value string")
    assert B.scan_dump_tables(df).count() == 0


def test_tables_are_retyped_and_copied(spark, tmp_path):
    for name in ("dev", "prod"):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    df = spark.createDataFrame([("2025-01-31", "1.5"), ("bad", "y")], "date string, km string")
    B.sink_retype(df, "dev.daily", {"km": "double"}, {"date": "yyyy-MM-dd"})
    assert sorted(map(str, spark.table("dev.daily").collect())) == sorted(map(str, spark.createDataFrame([(datetime.date(2025, 1, 31), 1.5), (None, None)], "date date, km double").collect()))
    for _ in range(2):
        assert [tuple(r) for r in B.sink_ctas_replicate(spark, ["daily"], "dev", "prod").collect()] == [("daily", 2, 2)]
    B.drop_tables(spark, ["daily", "absent"], "dev")
    assert not spark.catalog.tableExists("dev.daily") and spark.catalog.tableExists("prod.daily")
    spark.sql("DROP DATABASE prod CASCADE")
    spark.sql("DROP DATABASE dev CASCADE")


def test_signal_bytes(spark):
    frames = [("a", 1, 1000, 5, [0, 0xE, 0xC, 7]), ("a", 2, 1030, 6, [0xE, 0xC, 0, 0]), ("a", 3, 2000, 7, [1]), ("a", 4, 2000, 8, None), ("b", 5, 1000, 5, [0xC, 0xE])]
    frames = spark.createDataFrame(frames, "id string, sequence long, ts_ms long, can_id long, bytes array<int>")
    values = [("a", "big", 1020, 3.596), ("a", "little", 1020, 3.086), ("a", "late", 1051, 3.086), ("a", "zero", 1000, 0.0), ("a", "none", 1000, None)]
    got = G.signal_byte_search(frames, spark.createDataFrame(values, "id string, name string, ts_ms long, value double"))
    assert sorted((r.name, r.can_id, r.position, r.endian, r.hits) for r in got.collect()) == [("big", 5, 1, "BE", 2), ("little", 5, 1, "LE", 2)]


def test_ranges(spark):
    lines = spark.createDataFrame([(1, " SG_ Bat__V : [0|10]"), (2, "SG_ BAT_V :[-5|20]"), (3, "BO_ 5 x"), (4, None)], "n long, value string")
    columns = spark.createDataFrame([("bat_v",), ("pack_temperature7",), ("pack_t",), (None,)], "column string")
    got = G.expected_ranges(columns, G.ranges_of_lines(lines), [(r"^pack_temperature\d+$", -40, 215), (r"^pack_", 0, 1)])
    assert {r["column"]: (r.lo, r.hi) for r in got.collect()} == {"bat_v": (-5.0, 20.0), "pack_temperature7": (-40.0, 215.0), "pack_t": (0.0, 1.0), None: (None, None)}


def test_segment_sweeps(spark):
    rows = [("a", 0, []), ("a", 10, [1, 2]), ("a", 20, [3]), ("a", 30, None), ("a", 40, [2, 4, 99]), ("a", 50, [1]), ("b", 0, [1, 3]), (None, 5, [4, 1])]
    df = spark.createDataFrame([(i, t, n, s) for n, (i, t, s) in enumerate(rows)], "id string, t_sec long, sequence long, sensors array<int>")
    got = sorted((str(r.id), r.cycle, r.start, r.end, r.since, r.counts) for r in G.segment_sweeps(df, segments=2, group=2).collect())
    assert got == [("None", 1, 5, 5, None, [1, 1]), ("a", 1, 10, 20, None, [1, 1]), ("a", 2, 40, 40, 20, [1, 1]), ("b", 1, 0, 0, None, [1, 1])]


def test_segment_sweeps_of_many_short_chunks(spark, capsys):
    rng = random.Random(3)
    rows = [(None if v == 5 else str(v), 7 * i + rng.randrange(7), i, [rng.randrange(-1, 14) for _ in range(rng.randrange(4))]) for v in range(12) for i in range(150)]
    want = []
    for v in range(12):
        cycle, before, seen = 0, None, []
        for i, t, _, s in rows[150 * v : 150 * v + 150]:
            has = {(x - 1) // 3 for x in s if 0 < x <= 12}
            if not has:
                continue
            seen.append((t, has))
            if len(set().union(*(h for _, h in seen))) == 4:
                cycle += 1
                want.append((str(i), cycle, seen[0][0], t, None if before is None else seen[0][0] - before, [sum(g in h for _, h in seen) for g in range(4)]))
                before, seen = t, []
    assert len(want) > 100
    df = spark.createDataFrame(rows, "id string, t_sec long, sequence long, sensors array<int>")
    for chunk_sec in (10, 100, 10_000):
        found = G.segment_sweeps(df, segments=4, group=3, chunk_sec=chunk_sec)
        assert sorted((str(r.id), r.cycle, r.start, r.end, r.since, r.counts) for r in found.collect()) == sorted(want)
    # covers are found once: ways out of chunks, entries, covers
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("MapInArrow") == 3


def test_chunks_are_worked_on_together():
    ranks = [x for size in (3, 1, 5, 2, 400, 1, 1, 2) for x in range(-1, size)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ranks[i : i + 7])], ["rank"]) for i in range(0, len(ranks), 7)]
    tables = [t["rank"].to_pylist() for t in _chunks(iter(batches), 20)]
    assert sum(tables, []) == ranks and all(t[0] == -1 for t in tables)
    assert [t.count(-1) for t in tables] == [5, 3]
    assert len(list(_chunks(iter(batches)))) == 1 and not list(_chunks(iter([])))


def test_streaming_sweeps(spark, tmp_path):
    df = spark.createDataFrame([("a", 10 * i, s) for i, s in enumerate([0, 1, 1, None, 2, 0, 2, 1, 0])], "id string, t long, sensor int")
    for part, rows in enumerate((df.where("t <= 20"), df.where("t > 20"))):
        rows.select("id", F.timestamp_seconds("t").alias("ts"), "sensor").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, ts timestamp, sensor int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_sweep_cycles(source, 3).writeStream.format("memory").queryName("sweeps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.cycle, r.start, r.end, r.rows, r.since) for r in spark.table("sweeps").collect())
    assert got == [(1, 0, 40, 5, None), (2, 50, 70, 3, 10)]

"""Queries: dumps, retyped tables, the fleet view, signal ranges and bytes, sweeps by segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import signals as G
from fleetlens.plans.registry import query
from fleetlens.plans.sequences import CHUNK, _frames, cycles_sql
from fleetlens.sources import tables as B
from fleetlens.sources.telemetry import telemetry as tel


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dump(spark, sf):
    """Suppliers and customers as the lines of one dump."""
    out = None
    for no, (name, letter, key) in enumerate((("supplier", "s", "suppkey"), ("customer", "c", "custkey")), 1):
        df, base = _table(spark, sf, name), no * 10**12
        number = F.col(f"{letter}_{key}")
        cells = number, F.col(f"{letter}_name"), F.when(number % 10 != 3, F.col(f"{letter}_acctbal"))
        text = F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in cells))
        body = df.select((base + F.floor(number / 1000)).alias("block"), number.alias("n"), text.alias("value"))
        ends = spark.createDataFrame([(base - 1, 0, f"COPY public.{name} (key, name, balance) FROM stdin;"), (base + 10**11, 0, "\\.")], "block long, n long, value string")
        out = body.unionByName(ends) if out is None else out.unionByName(body).unionByName(ends)
    return out.withColumn("file", F.lit("dump"))


@query("scan_dump_tables", "SELECT 'supplier' AS \"table\", s_suppkey AS key, s_name AS name, CASE WHEN s_suppkey % 10 <> 3 THEN s_acctbal END AS balance FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, CASE WHEN c_custkey % 10 <> 3 THEN c_acctbal END FROM customer")
def scan_dump_tables(spark, sf):
    rows = B.scan_dump_tables(_dump(spark, sf))
    one = lambda name: B.dump_table(rows, name, {"key": "long", "name": "string", "balance": "double"}).select(F.lit(name).alias("table"), "*")
    return one("supplier").unionByName(one("customer"))


@query("sink_retype", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS date)) AS int) END AS day, o_totalprice AS price FROM orders")
def sink_retype(spark, sf):
    """Orders whose days and prices came as text."""
    text = _table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a").alias("day"), F.col("o_totalprice").cast("string").alias("price"))
    return B.retype(text, {"price": "double"}, {"day": "yyyy-MM-dd"}).withColumn("day", F.unix_date("day"))


@query("fleet_filter_view", """SELECT c_custkey AS vehicle_id, d.o_orderkey AS device_id, r_name AS operator_name, s_suppkey IS NOT NULL AS has_route, a.name AS start_city_name, b.name AS end_city_name,
 coalesce(d.o_orderkey IS NOT NULL AND d.vendor IS NOT NULL AND d.status = 'ACTIVE' AND m.o_orderdate <= TIMESTAMP '1997-01-01' AND m.o_orderstatus = 'O', false) AS is_current_active_device
FROM customer LEFT JOIN orders m ON m.o_custkey = c_custkey
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS vendor, CASE WHEN o_totalprice > 50000 THEN 'ACTIVE' ELSE 'IDLE' END AS status FROM orders WHERE o_orderkey % 5 <> 0) d ON d.o_orderkey = m.o_orderkey
LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n.n_regionkey AND r_regionkey < 4
LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation t ON t.n_nationkey = s_nationkey
LEFT JOIN (SELECT r_regionkey AS k, r_name AS name FROM region) a ON a.k = t.n_regionkey LEFT JOIN (SELECT r_regionkey AS k, r_name AS name FROM region) b ON b.k = t.n_nationkey % 5""")
def fleet_filter_view(spark, sf):
    """Customers as vehicles of their nation's fleet, orders as devices, suppliers as routes."""
    t = lambda name: _table(spark, sf, name)
    nation, region, orders = t("nation"), t("region"), t("orders")
    out = G.fleet_filter_view(
        t("customer").select(F.col("c_custkey").alias("vehicle_id"), F.col("c_nationkey").alias("fleet_id")),
        orders.select(F.col("o_custkey").alias("vehicle_id"), F.col("o_orderkey").alias("mapped_device"), F.col("o_orderdate").alias("installed"), F.when(F.coalesce(F.col("o_orderstatus") != "O", F.lit(True)), F.col("o_orderdate")).alias("uninstalled")),
        orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("device_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("vendor_device_id"), F.when(F.col("o_totalprice") > 50000, "ACTIVE").otherwise("IDLE").alias("device_status")),
        nation.select(F.col("n_nationkey").alias("fleet_id"), F.col("n_regionkey").alias("mapped_operator")),
        region.where("r_regionkey < 4").select(F.col("r_regionkey").alias("operator_id"), F.col("r_name").alias("operator_name")),
        t("supplier").select(F.col("s_suppkey").alias("vehicle_id"), F.col("s_nationkey").alias("mapped_route")),
        nation.select(F.col("n_nationkey").alias("route_id"), F.col("n_regionkey").alias("start_city_id"), (F.col("n_nationkey") % 5).alias("end_city_id")),
        region.select(F.col("r_regionkey").alias("city_id"), F.col("r_name").alias("city_name")),
        F.lit("1997-01-01").cast("timestamp_ntz"),
    )
    return out.select("vehicle_id", "device_id", "operator_name", F.col("route_id").isNotNull().alias("has_route"), "start_city_name", "end_city_name", "is_current_active_device")


@query("expected_ranges", "SELECT 'PART_' || p_partkey AS \"column\", CAST(CASE WHEN p_size <= 25 THEN 0 WHEN p_partkey % 10 = 0 THEN -40 END AS double) AS lo, CAST(CASE WHEN p_size <= 25 THEN p_size WHEN p_partkey % 10 = 0 THEN 215 END AS double) AS hi FROM part")
def expected_ranges(spark, sf):
    """A dictionary with a line for each small part; the other names may belong to a family."""
    part = _table(spark, sf, "part")
    lines = part.where("p_size <= 25").select(F.format_string("  SG_ Part__%d : [0|%d]", "p_partkey", "p_size").alias("value"), F.col("p_partkey").alias("n"))
    columns = part.select(F.format_string("PART_%d", "p_partkey").alias("column"))
    return G.expected_ranges(columns, G.ranges_of_lines(lines), [(r"^part_\d*0$", -40.0, 215.0)])


@query("signal_byte_search", """WITH f AS (SELECT id, sequence, t_sec * 1000 AS ms, sequence % 4 + 256 AS can_id, list_value(sequence % 251, sequence % 16, sequence % 241, sequence % 16, sequence % 239, sequence % 16, sequence % 233, sequence % 16) AS b FROM tel),
v AS (SELECT id, 'a' AS name, ms + 7 AS vt, sequence % 251 + 256 * (sequence % 16) AS raw FROM f UNION ALL SELECT id, 'b', ms - 20, 256 * (sequence % 239) + sequence % 16 FROM f),
p AS (SELECT id, sequence, ms, can_id, k, e, CASE e WHEN 0 THEN b[k + 1] + 256 * b[k + 2] ELSE 256 * b[k + 1] + b[k + 2] END AS raw FROM f, range(7) t(k), range(2) u(e)),
h AS (SELECT v.id, name, can_id, k, e, row(vt, ms, sequence, k, e) AS o FROM v JOIN p ON v.id = p.id AND v.raw = p.raw AND abs(ms - vt) <= 20 WHERE v.raw > 0)
SELECT id, name, arg_min(can_id, o) AS can_id, CAST(arg_min(k, o) AS int) AS position, CASE arg_min(e, o) WHEN 1 THEN 'BE' ELSE 'LE' END AS endian, count(*) AS hits FROM h GROUP BY id, name""")
def signal_byte_search(spark, sf):
    """Two signals, parsed a few milliseconds from their frames."""
    times = tel(spark, sf).select("id", "sequence", (F.col("t_sec") * 1000).alias("ts_ms"))
    frames = _frames(spark, sf).join(times, ["id", "sequence"])
    n = F.col("sequence")
    a = times.select("id", F.lit("a").alias("name"), F.col("ts_ms") + 7, (n % 251 + 256 * (n % 16)) / 1000)
    b = times.select("id", F.lit("b").alias("name"), F.col("ts_ms") - 20, (256 * (n % 239) + n % 16) / 1000)
    return G.signal_byte_search(frames, a.union(b).toDF("id", "name", "ts_ms", "value"))


@query("segment_sweeps", cycles_sql("list_distinct([(tmax_no - 1) // 8, (tmin_no - 1) // 8])", 14) + """, ct AS (SELECT cy.id, cycle, g, count(*) AS k FROM cy JOIN (SELECT id, n, unnest(s) AS g FROM ra) u ON u.id = cy.id AND u.n BETWEEN f AND l GROUP BY ALL)
SELECT cy.id, cy.cycle, start, "end", since, string_agg(k, ',' ORDER BY g) AS counts FROM cy JOIN ct ON ct.id = cy.id AND ct.cycle = cy.cycle GROUP BY ALL""")
def segment_sweeps(spark, sf):
    found = G.segment_sweeps(tel(spark, sf).withColumn("sensors", F.array("tmax_no", "tmin_no")), segments=14, chunk_sec=CHUNK)
    return found.withColumn("counts", F.array_join(F.transform("counts", lambda n: n.cast("string")), ","))

"""Registered queries through files: text, workbooks, keyed tables, streams and batches,
with the suggestions and selections that have no place in the grid's own queries. Each
writes whole tables into the shared folder and reads them again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grid, labels, selection
from .plans import batch
from .plans.pipeline import build_output
from .queries import _BASE, _formula, _named, _scratch, _sql, _static, _t, config, inputs, run
from .sources import sinks, tables, workbooks
from .streaming import watcher

CELLS = ["nation", "segment", "period"]
PRICE_LIMIT = 200000


def _workbook(spark: SparkSession, d: str) -> DataFrame:
    """Orders written to one workbook by tasks, with marks, line breaks and empty cells, read in ranges."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), F.concat(F.lit("<"), "o_orderpriority", F.lit("> & \"\n"), "o_orderstatus").alias("label"),
        F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice", 2)).alias("price"), F.col("o_orderdate").cast("date").alias("order date"),
    )
    path = workbooks.write_workbook({"Orders": o, "Open": o.filter("price is null")}, f"{_scratch(spark)}.xlsx")
    back = tables.read_workbook(spark, path, "Orders", 0)
    return back.select("key", "label", F.round("price", 2).alias("price"), F.col("order date").alias("order_date"))


def _text(which: int) -> Callable[[SparkSession, str], DataFrame]:
    """Customers as text; those of one nation have a cell more than the header."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        path = _scratch(spark)
        more = F.when(F.col("c_nationkey") == 3, F.lit("more"))
        line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_mktsegment", "c_name", more)
        _t(spark, d, "customer").select(line.alias("key;segment;name")).write.options(header=True, sep="\x01").csv(path)
        out = tables.parse_text(spark, path, sep=";")[which]
        return out.select("problem", "raw") if which else out

    return q


def _tidy(spark: SparkSession, d: str) -> DataFrame:
    """Cells as a sheet gives them: empty rows, an unnamed empty column, days as serial numbers."""
    o, there = _t(spark, d, "orders"), F.col("o_orderstatus") != "P"
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    cells = o.select(F.when(there, F.col("o_orderkey").cast("string")).alias("key"), F.when(there, F.lit(" ")).alias("Unnamed: 2"), F.when(there, serial).alias("Order Date"), F.when(there, F.col("o_orderpriority")).alias("priority"))
    out = tables.tidy(cells)
    return out.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in out.columns])


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """The grid gated and loaded twice into a keyed table; dear rows are quarantined."""
    path = _scratch(spark)
    for _ in range(2):
        result = build_output(inputs(spark, d), config(validations=[{"column": "price", "type": "max", "value": PRICE_LIMIT, "blocking": True}]))
        batch.load(result, path, CELLS)
    return _named(sinks.read_table(spark, path))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """New rows land as files; one micro-batch takes them through the plan into the table."""
    i, base = inputs(spark, d), _scratch(spark)
    i.new.write.parquet(f"{base}/landing")
    watcher.watch(spark, f"{base}/landing", i.new.schema, i.master, i.historical, config(), f"{base}/table", f"{base}/checkpoint", CELLS, glob="*.parquet", files=1_000_000).awaitTermination()
    return _named(sinks.read_table(spark, f"{base}/table"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Files of orders land, then files with later prices of the open ones; each look takes what changed."""
    o, base = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), _scratch(spark)

    def take(event: dict) -> dict:
        return sinks.upsert(spark.read.parquet(f"{base}/landing/{event['name']}"), f"{base}/table", ["o_orderkey"])

    for rows in (o, o.filter("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") + 1)):
        rows.write.mode("append").parquet(f"{base}/landing")
        watcher.follow(spark, f"{base}/landing", take, f"{base}/checkpoint", "*.parquet", stable_seconds=0).awaitTermination()
    return sinks.read_table(spark, f"{base}/table").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


def _medians(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a few values each of the whole table, so all are hot."""
    cells = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("x"))
    return selection.medians(cells, ["l_returnflag", "l_linestatus"]).withColumn("median", F.round("median", 4))


SHARED = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _equal(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of number columns the share of rows in which they say the same."""
    shares = labels.equal_shares(_t(spark, d, "lineitem"), SHARED)
    return spark.createDataFrame([(a, b, round(s, 6)) for (a, b), s in shares.items()], "left_name string, right_name string, share double")


def _crosswalk(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").withColumn("__row_id", F.col("n_nationkey").cast("bigint"))
    sheet = n.select("__row_id", F.concat(F.lit(" n-"), F.col("n_nationkey").cast("string")).alias("code"), F.initcap("n_name").alias("name"))
    found = labels.collect_crosswalks(sheet, n.select("__row_id", F.col("n_name").alias("nation")))
    return spark.createDataFrame([(c, k, v) for c, pairs in found.items() for k, v in pairs.items()], "target string, label string, standard string")


def _combinations(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of which some lack a label; those that lack all go. Filters of an unknown column or operator keep all."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("__row_id"), F.when(F.col("c_nationkey") != 7, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("area"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    kept = grid.master_filter(grid.master_filter(c, "gone", "eq", "x"), "area", "like", "x")
    return grid.combinations(kept, ["area", "segment"], ["area", "segment"]).select("master.area", "master.segment", F.col("__combo_ix").alias("ordinal"))


def _random_members(spark: SparkSession, d: str) -> DataFrame:
    """Each filled row of a random donor, and whether that is an order of its own labels."""
    history = inputs(spark, d).historical.select(F.col("nation").alias("n"), F.col("segment").alias("s"), F.col("order_id").alias("o"))
    out = _named(run(spark, d, gapfill={"donor_strategy": "random"}).output).filter("source = 'FILLED'")
    own = out.join(history, (F.col("o") == F.col("order_id")) & (F.col("n") == F.col("nation")) & (F.col("s") == F.col("segment")), "left")
    return own.select(*CELLS, "fill_basis", F.col("o").isNotNull().alias("own"))


RANDOM = "IF(RANDBETWEEN([qty], [qty] + 5) >= [qty], 1, 0) + IF(RANDBETWEEN([qty], [qty] + 5) <= [qty] + 5, 1, 0) + IF(RANDBETWEEN(7, 7) = 7, 1, 0) + IF(RAND() < 1, 1, 0)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "workbook_round_trip": _workbook,
        "text_good_records": _text(0),
        "text_problem_records": _text(1),
        "tidy_cells": _tidy,
        "batch_load": _batch,
        "stream_load": _stream,
        "stream_changes": _changes,
        "hot_group_medians": _medians,
        "equal_columns": _equal,
        "crosswalk_labels": _crosswalk,
        "partial_combinations": _combinations,
        "donor_random_members": _random_members,
        "formula_random": _formula(RANDOM),
    }


def oracle_sql() -> dict[str, str]:
    last = _sql(_static("arg_max", "row_id + 100000000 * date_diff('day', DATE '1970-01-01', period)"))
    share = lambda a, b: f"SELECT '{a}' AS left_name, '{b}' AS right_name, round(avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem"
    pairs = [(a, b) for i, a in enumerate(SHARED) for b in SHARED[i + 1 :]]
    return {
        "workbook_round_trip": "SELECT o_orderkey AS key, '<' || o_orderpriority || '> & \"' || chr(10) || o_orderstatus AS label, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS price, CAST(o_orderdate AS DATE) AS order_date FROM orders",
        "text_good_records": "SELECT c_custkey AS key, c_mktsegment AS segment, c_name AS name FROM customer WHERE c_nationkey <> 3",
        "text_problem_records": "SELECT 'more cells than the header' AS problem, c_custkey || ';' || c_mktsegment || ';' || c_name || ';more' AS raw FROM customer WHERE c_nationkey = 3",
        "tidy_cells": "SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'P'",
        "batch_load": f"SELECT * FROM ({last}) WHERE price IS NULL OR price <= {PRICE_LIMIT}",
        "stream_load": last,
        "stream_changes": "SELECT o_orderkey, o_orderstatus, round(o_totalprice + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, 2) AS price FROM orders",
        "hot_group_medians": "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY ALL",
        "equal_columns": " UNION ALL ".join(share(a, b) for a, b in pairs),
        "crosswalk_labels": "SELECT 'nation' AS target, 'N-' || n_nationkey AS label, upper(n_name[1]) || lower(n_name[2:]) AS standard FROM nation",
        "partial_combinations": """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN 'n' || c_nationkey END AS area, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer)
SELECT area, segment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS ordinal FROM c WHERE area IS NOT NULL OR segment IS NOT NULL GROUP BY area, segment""",
        "donor_random_members": f"""WITH {_BASE} SELECT g.nation, g.segment, g.period, CASE WHEN h.nation IS NOT NULL THEN 'nation + segment' WHEN s.segment IS NOT NULL THEN 'segment' END AS fill_basis, h.nation IS NOT NULL AS own
FROM g ANTI JOIN n USING (nation, segment, period) LEFT JOIN (SELECT DISTINCT nation, segment FROM h) h ON h.nation = g.nation AND h.segment = g.segment LEFT JOIN (SELECT DISTINCT segment FROM h) s ON s.segment = g.segment""",
        "formula_random": "SELECT o_orderkey, CAST(4 AS DOUBLE) AS result FROM orders",
    }

"""Registered queries over the star schema, and the same results as DuckDB SQL.

master: nations by market segments; new: orders from 1998 with their customer's nation and
segment, by month; historical: the orders before. events make a second, sparser grid.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formula import Value, compile_formula
from .functions.keys import date_serial, kind_of
from .operators import dedupe, grid, labels, quality
from .plans.pipeline import Inputs, Result, build_output, final_types
from .scratch import folder
from .sources import sinks, tables

SPLIT = "1998-01-01"
DIMS = [{"master": "nation", "new": "nation", "hist": "nation"}, {"master": "segment", "new": "segment", "hist": "segment"}]
OUTPUT = ["nation", "segment", "period", "price", "order_id", "region"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("__row_id"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.trunc("o_orderdate", "month").alias("period"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("order_id"),
    )


def inputs(spark: SparkSession, d: str) -> Inputs:
    rows = orders(spark, d)
    segments = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    master = _t(spark, d, "nation").crossJoin(segments).select(
        F.concat("n_nationkey", F.lit("-"), "segment").alias("code"), F.col("n_name").alias("nation"), "segment", F.col("n_regionkey").cast("bigint").alias("region"),
        (F.col("n_nationkey").cast("bigint") * 100 + F.ascii("segment")).alias("__row_id"),
    )
    return Inputs(rows.filter(F.col("period") >= SPLIT), master, rows.filter(F.col("period") < SPLIT))


def config(**changes) -> dict:
    out = {
        "grid": {"master_dims": DIMS, "new_date_column": "period", "dedupe": {"strategy": "first"}},
        "output_columns": [{"name": c, "source": {"type": "new", "column": c}} for c in OUTPUT if c != "region"] + [{"name": "region", "source": {"type": "master", "column": "region"}}],
        "gapfill": {"hist_date_column": "period", "donor_strategy": "last"},
    }
    for k, v in changes.items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def run(spark: SparkSession, d: str, **changes) -> Result:
    return build_output(inputs(spark, d), config(**changes))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"SOURCE": "source", "FILL BASIS": "fill_basis"})


def _full(**changes) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _named(run(s, d, **changes).output)


# SQL building blocks.
_BASE = f"""o AS (
  SELECT o_orderkey AS row_id, n_name AS nation, c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         o_totalprice AS price, o_orderkey AS order_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n0 AS (SELECT * FROM o WHERE period >= DATE '{SPLIT}'),
h AS (SELECT * FROM o WHERE period < DATE '{SPLIT}'),
m AS (SELECT n_name AS nation, segment, CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) * 100 + ascii(segment) AS row_id
      FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer)),
n AS (SELECT nation, segment, period, arg_min(price, row_id) AS price, min(order_id) AS order_id FROM n0 GROUP BY ALL),
g AS (SELECT m.nation, m.segment, m.region, d.period, (row_number() OVER (ORDER BY m.row_id, d.period)) - 1 AS grid_id
      FROM m CROSS JOIN (SELECT DISTINCT period FROM n0) d)"""


def _sql(donor: str, price: str = "coalesce(n.price, d.price)", more: str = "", where: str = "") -> str:
    """donor: select of nation, segment[, period], price, order_id, basis, joined by names."""
    on = "d.nation = g.nation AND d.segment = g.segment" + (" AND d.period = g.period" if "AS at_period" in donor else "")
    return f"""WITH {_BASE}, d AS ({donor.replace(' AS at_period', ' AS period')})
SELECT g.nation, g.segment, g.period, {price} AS price, CASE WHEN n.nation IS NULL THEN d.order_id ELSE n.order_id END AS order_id,
       g.region, CASE WHEN n.nation IS NULL THEN 'FILLED' ELSE 'ACTUAL' END AS source,
       CASE WHEN n.nation IS NULL THEN d.basis END AS fill_basis{more}
FROM g LEFT JOIN n ON n.nation = g.nation AND n.segment = g.segment AND n.period = g.period LEFT JOIN d ON {on} {where}"""


def _static(pick: str, order: str) -> str:
    return f"""SELECT nation, segment, {pick}(price, {order}) AS price, {pick}(order_id, {order}) AS order_id, 'nation + segment' AS basis FROM h GROUP BY ALL"""


_ASOF = {
    "previous": f"""SELECT x.nation, x.segment, x.period AS at_period, coalesce(p.price, l.price) AS price, coalesce(p.order_id, l.order_id) AS order_id, 'nation + segment' AS basis
      FROM g x LEFT JOIN LATERAL (SELECT price, order_id FROM h WHERE h.nation = x.nation AND h.segment = x.segment AND h.period <= x.period ORDER BY period DESC, row_id DESC LIMIT 1) p ON true
      JOIN ({_static('arg_max', "row_id + 100000000 * date_diff('day', DATE '1970-01-01', period)")}) l ON l.nation = x.nation AND l.segment = x.segment""",
}

FORMULAS = {
    "formula_arith": ("[price] * 2 - [qty] / 4 + ROUND([price], 1)", "o_totalprice * 2 - qty / 4.0 + round_even(o_totalprice * 10, 0) / 10"),
    "formula_mod": ("MAX([qty] % -7, -5) + [qty] ** 2", "greatest(qty - (-7) * floor(qty / -7.0), -5) + pow(qty, 2)"),
    "formula_text": ("UPPER(LEFT([status], 1)) & \"-\" & PAD([qty], 6) & RIGHT([priority], 3)", "upper(left(o_orderstatus, 1)) || '-' || lpad(CAST(qty AS VARCHAR), 6, '0') || right(o_orderpriority, 3)"),
    "formula_compare": ("IF([price] > 100000, \"high\", IF([price] <= 20000, \"low\", \"mid\"))", "CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice <= 20000 THEN 'low' ELSE 'mid' END"),
    "formula_logic": ("IF([price] > 50000 AND NOT [status] = \"F\" OR [qty] < 10, 1, 0)", "CASE WHEN (o_totalprice > 50000 AND NOT o_orderstatus = 'F') OR qty < 10 THEN CAST(1 AS DOUBLE) ELSE 0 END"),
    "formula_null": ("IFERROR([price] / ([qty] - [qty]), -1) + COALESCE([gone], 5) + IF(ISBLANK([gone]), 1, 0)", "CAST(-1 + 5 + 1 AS DOUBLE)"),
    "formula_round": ("ROUNDUP([price] / 1000, 1) + ROUNDDOWN([price] / 1000, 1) + INT([price] / 7)", "ceil(o_totalprice / 1000 * 10) / 10 + floor(o_totalprice / 1000 * 10) / 10 + floor(o_totalprice / 7)"),
    "formula_minmax": ("MIN([qty], 50) + MAX([qty], 10, [gone]) + SUM([qty], [gone]) + AVERAGE([qty], [gone], 4)", "least(qty, 50) + greatest(qty, 10) + qty + (qty + 4) / 2.0"),
    "formula_dates": ("YEAR([day]) * 10000 + MONTH([day]) * 100 + DAY([day])", "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS DOUBLE)"),
    "formula_pad": ("PAD([priority], 12, \"*\") & \"|\" & TRIM(\"  x \") & LEN([priority])", "lpad(o_orderpriority, CAST(greatest(12, length(o_orderpriority)) AS INTEGER), '*') || '|x' || length(o_orderpriority)"),
    "formula_proper": ("PROPER([priority]) & LOWER([status])", "CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END || lower(o_orderstatus)"),
    "formula_value": ("VALUE(LEFT([priority], 1)) + ABS(-3) + LEN(TEXT([qty]))", "CAST(left(o_orderpriority, 1) AS DOUBLE) + 3 + length(CAST(qty AS VARCHAR))"),
}


def _formula(expr: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        df = _t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 100).alias("qty"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day"), F.lit(None).cast("double").alias("gone"))
        out = compile_formula(expr, lambda r: Value(F.col(r), kind_of(df.schema[r].dataType)))
        col = F.round(out.col, 6) if out.kind == "number" else out.col
        return df.select("o_orderkey", col.alias("result"))

    return q


_RULES = {
    "non_negative": ({"column": "c_acctbal", "type": "non_negative"}, "c_acctbal < 0"),
    "positive": ({"column": "c_acctbal", "type": "positive"}, "c_acctbal <= 0"),
    "not_blank": ({"column": "c_name", "type": "not_blank"}, "c_name IS NULL OR trim(c_name) = ''"),
    "min": ({"column": "c_acctbal", "type": "min", "value": 500}, "c_acctbal < 500"),
    "max": ({"column": "c_acctbal", "type": "max", "value": 9000}, "c_acctbal > 9000"),
    "between": ({"column": "c_acctbal", "type": "between", "min": 0, "max": 5000}, "c_acctbal < 0 OR c_acctbal > 5000"),
    "range_pct": ({"column": "c_acctbal", "type": "range_pct", "pct": 50, "reference": "c_ref"}, "c_acctbal < least(c_custkey * 3.0, c_custkey * 9.0) OR c_acctbal > greatest(c_custkey * 3.0, c_custkey * 9.0)"),
    "unique": ({"column": "c_nationkey", "type": "unique"}, "count(*) OVER (PARTITION BY c_nationkey) > 1"),
}


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").withColumns({"c_ref": F.col("c_custkey") * 6.0, "__grid_id": F.col("c_custkey")})


def _rule(rule: dict) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        df = quality.prepare(_customers(spark, d), [rule])
        compiled, _ = quality.compile_rules([rule], df)
        return df.select("c_custkey", compiled[0].breach.alias("breach"))

    return q


def _issues(spark: SparkSession, d: str) -> DataFrame:
    rules = [_RULES["non_negative"][0], _RULES["max"][0], _RULES["unique"][0] | {"blocking": True}]
    df = quality.prepare(_customers(spark, d), rules)
    compiled, _ = quality.compile_rules(rules, df)
    out = quality.issues(df, compiled, cap=100)
    return out.select(*[F.col(c).alias(c.lower() if c not in ("Row", "Column", "Value") else f"issue_{c.lower()}") for c in out.columns])


_GATE = [_RULES["non_negative"][0] | {"blocking": True}, _RULES["max"][0] | {"blocking": True}, _RULES["min"][0]]


def _gate(which: int) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        df = _customers(spark, d)
        out = quality.gate(df, quality.compile_rules(_GATE, df)[0])[which]
        return out.select("c_custkey", "c_acctbal") if which == 0 else out.select("c_custkey", "c_acctbal", F.col("QC_REASON").alias("qc_reason"))

    return q


def _gate_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Of three rules only the maximum blocks: the list names two, and one only warns."""
    named = lambda r: {"column": r["column"], "type": r["type"]}
    profile = {"validations": [_RULES["non_negative"][0], _RULES["min"][0]]}
    qc = {"extra_validations": [_RULES["max"][0]], "blocking": [named(_RULES[k][0]) for k in ("non_negative", "max")], "warn_only": [named(_RULES["non_negative"][0])]}
    df = _customers(spark, d)
    bad = quality.gate(df, quality.compile_rules(quality.assemble_rules(profile, {"qc": qc}), df)[0])[1]
    return bad.select("c_custkey", "c_acctbal", F.col("QC_REASON").alias("qc_reason"))


_DEDUPES = {"first": "arg_min(v, k)", "last": "arg_max(v, k)", "sum": "coalesce(sum(v), 0)", "mean": "avg(v)", "median": "median(v)", "max": "max(v)", "min": "min(v)"}


def _dedupe(strategy: str, overrides: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        df = _t(spark, d, "lineitem").select(
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("__row_id"), "l_partkey", "l_returnflag",
            F.when(F.col("l_discount") > 0.03, F.col("l_quantity")).alias("v"), F.col("l_linestatus").alias("status"), F.col("l_tax").alias("tax"),
        )
        out = dedupe.dedupe(df, ["l_partkey", "l_returnflag"], strategy, {"status": "last", "tax": "max"} | (overrides or {}))
        return out.select("l_partkey", "l_returnflag", F.round("v", 4).alias("v"), "status", "tax")

    return q


def _standardise(action: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        i = inputs(spark, d)
        renamed = i.new.withColumn("segment", F.when(F.col("segment") == "BUILDING", F.lit(" building trade ")).otherwise(F.col("segment")))
        decision = {"segment": {"Building Trade": {"action": action, "to": "BUILDING"}}}
        new, master, _ = labels.apply_decisions(renamed, i.master, [{"new": "nation", "master": "nation"}, {"new": "segment", "master": "segment"}], decision)
        if action == "map":
            return new.groupBy("segment").agg(F.count("*").alias("n"))
        return master.groupBy(F.trim("segment").alias("segment")).agg(F.count("*").alias("n"))

    return q


def _events_grid(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("__row_id"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("day"), "value")
    master = e.groupBy("user").agg(F.min("__row_id").alias("r")).crossJoin(e.groupBy("kind").agg(F.min("__row_id").alias("q"))).select("user", "kind", (F.col("r") * 1000003 + F.col("q")).alias("__row_id"))
    cfg = {
        "grid": {"master_dims": [{"master": "user", "new": "user", "hist": "user"}, {"master": "kind", "new": "kind", "hist": "kind"}], "new_date_column": "day", "dedupe": {"strategy": "sum"}},
        "output_columns": [{"name": c, "source": {"type": "new", "column": c}} for c in ("user", "kind", "day", "value")],
        "gapfill": {"hist_date_column": "day", "rules": [{"column": "value", "type": "const", "value": 0}]},
    }
    out = build_output(Inputs(e, master, e.limit(0)), cfg).output
    return out.select("user", "kind", "day", F.round("value", 4).alias("value"), F.col("SOURCE").alias("source"))


def _prior_incoming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers of 15 nations, and those of the later 15 with a higher balance."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.filter("c_nationkey < 15"), c.filter("c_nationkey >= 10").withColumn("c_acctbal", F.col("c_acctbal") + 1)


def _scratch(spark: SparkSession) -> str:
    return f"{folder(spark)}/queries-{uuid.uuid4().hex}"


def _upsert_table(spark: SparkSession, d: str, partition: str | None = None) -> DataFrame:
    path = _scratch(spark)
    for rows in _prior_incoming(spark, d):
        sinks.upsert_partitions(rows, path, ["c_nationkey", "c_custkey"], partition) if partition else sinks.upsert(rows, path, ["c_nationkey", "c_custkey"])
    return sinks.read_table(spark, path).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def _upsert_text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Customers keyed by texts with leading zeros, some null, in three overlapping loads."""
    path, n = _scratch(spark), F.col("c_nationkey")
    c = _t(spark, d, "customer").select(F.when(n != 7, F.lpad(n.cast("string"), 3, "0")).alias("area"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"), "c_acctbal", n.alias("n"))
    for low, high in ((0, 15), (5, 10), (10, 25)):
        sinks.upsert_partitions(c.filter(f"n >= {low} and n < {high}").withColumn("c_acctbal", F.round(F.col("c_acctbal") + low, 2)).drop("n"), path, ["area", "code"], "area")
    return sinks.read_table(spark, path).select("area", "code", F.round("c_acctbal", 2).alias("balance"))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as text files with quoted line breaks, inch marks and numbers like 007, read again."""
    path = _scratch(spark)
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat("p_name", F.lit(";\n"), "p_brand").alias("label"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size code"), F.col("p_retailprice").cast("string").alias("price"), F.concat("p_size", F.lit('" '), "p_type").alias("kind"))
    p.repartition(4).write.options(header=True, sep=";", quote='"', escape='"').csv(path)
    out = tables.read_text(spark, path)
    return out.select(F.col("key").alias("part_key"), "label", F.col("size code").alias("size_code"), F.round("price", 2).alias("price"), "kind")


def _types(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("part_key"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size_code"), F.col("p_retailprice").cast("string").alias("price"), "p_name", F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("string").alias("day"))
    return final_types(p).withColumn("price", F.round("price", 2))


def _display(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_orderdate").cast("timestamp").alias("placed"))
    e = _t(spark, d, "events").select(F.col("event_id").alias("o_orderkey"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("placed"))
    return sinks.display(o.unionByName(e))


def _report(spark: SparkSession, d: str) -> DataFrame:
    i = inputs(spark, d)
    new = i.new.withColumn("segment", F.when(F.col("segment").isin("BUILDING", "MACHINERY"), F.concat("segment", F.lit("S"))).otherwise(F.lower("segment")))
    pairs = [{"new": "nation", "master": "nation"}, {"new": "segment", "master": "segment"}, {"new": "price", "master": "region"}]
    return labels.report(new, i.master, pairs)[0]


def _unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The second table of the report: labels that master has not, with what is proposed."""
    i = inputs(spark, d)
    new = i.new.withColumn("segment", F.when(F.col("price") > 200000, F.concat("segment", F.lit("S"))).otherwise(F.lower("segment")))
    rows = labels.report(new, i.master, [{"new": "nation", "master": "nation"}, {"new": "segment", "master": "segment"}])[1]
    return rows.select("new_column", "master_column", "value", F.col("rows").alias("n"), "action", F.col("to").alias("standard"), "confidence")


def _value_maps(spark: SparkSession, d: str) -> DataFrame:
    """Customers name nations by codes; of two sheets one turns them into names."""
    n = _t(spark, d, "nation").withColumn("__row_id", F.col("n_nationkey").cast("bigint"))
    code = F.concat(F.lit("n-"), F.col("n_nationkey").cast("string"))
    new = _t(spark, d, "customer").select(F.col("c_custkey").alias("__row_id"), F.concat(F.lit("N-"), F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    sheets = {"codes": n.filter("n_nationkey < 20").select("__row_id", code.alias("code"), F.col("n_name").alias("name")), "other": n.select("__row_id", F.concat("n_name", F.lit("?")).alias("name"), F.col("n_name").alias("label"))}
    out = labels.suggest_value_maps(new, n.select("__row_id", F.col("n_name").alias("nation")), sheets)
    return out.withColumnsRenamed({"column": "new_column"})


def _samples(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("__row_id"), F.when(F.col("c_custkey") % 4 > 1, F.col("c_name")).alias("c_name"), "c_nationkey", "c_mktsegment")
    return labels.profile(c).select(F.col("column").alias("column_name"), "non_null", "nulls", "distinct_values", F.array_join("samples", "|").alias("samples"))


def _suggest(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts, one letter in three places left out, matched with the names."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("__row_id"), "p_name", "p_size")
    at = F.col("p_size") % 5 + 1
    wrong = p.withColumn("p_name", F.concat(F.substring("p_name", F.lit(1), at), F.substring("p_name", at + 2, F.lit(100))))
    return labels.suggest(labels.unmatched(wrong, p, "p_name", "p_name"), p, "p_name")


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    prior, incoming = _prior_incoming(spark, d)
    once = sinks.upsert_frames(prior, incoming, ["c_custkey"])
    return sinks.upsert_frames(once, incoming, ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def _append(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return sinks.append_new_dates(o.filter("order_date < '1997-06-15'"), o.withColumnRenamed("order_date", "ORDER_DATE"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    derived = [{"name": "per_unit", "expr": "ROUND([out.price] / 12, 2)"}]
    chain = [[{"grid": "nation", "hist": "nation"}, {"grid": "segment", "hist": "gone"}], [{"grid": "segment", "hist": "segment"}]]
    out = {
        "grid_complete": _full(),
        "gap_rows": lambda s, d: _named(run(s, d).output.filter("SOURCE = 'FILLED'")),
        "excluded_anti": lambda s, d: run(s, d, grid={"master_filter": {"column": "segment", "op": "ne", "value": "building"}}).excluded.select("order_id", "nation", "segment"),
        "grid_range_dates": lambda s, d: _named(run(s, d, grid={"date_mode": "range", "date_from": "1998-01-01", "date_to": "1998-01-10"}).output).select("nation", "segment", "period", "source"),
        "gapfill_off": _full(gapfill={"enabled": False}),
        "donor_undated": lambda s, d: _full(gapfill={"hist_date_column": None})(s, d).drop("period"),
        "donor_random": _full(gapfill={"donor_strategy": "random"}),
        "grid_explicit_dates": lambda s, d: _named(run(s, d, grid={"date_mode": "explicit", "dates": ["1998-05-01", "1998-02-01", "2001-01-01"]}).output).select("nation", "segment", "period", "source"),
        "fill_coalesce": _full(gapfill={"rules": [{"column": "price", "type": "coalesce", "sources": [{"type": "donor", "column": "gone"}, {"type": "new_donor", "column": "price"}, {"type": "donor", "column": "price"}]}]}),
        "fill_pool": lambda s, d: run(s, d, add_pool=True).output.select("nation", "segment", "period", F.col("FILL POOL").alias("fill_pool")),
        "id_blank": _full(gapfill={"id_policy": {"column": "order_id", "mode": "blank"}}),
        "id_constant": _full(gapfill={"id_policy": {"column": "order_id", "mode": "constant", "value": -7}}),
        "id_donor": _full(gapfill={"id_policy": {"column": "order_id", "mode": "donor"}}),
        "grid_stats": lambda s, d: run(s, d).stats,
        "dropped_variants": lambda s, d: run(s, d, grid={"dedupe": {"strategy": "none"}}).variants,
        "preview_cells": lambda s, d: _named(run(s, d, preview_limit=200).output).select("nation", "segment", "period", "price", "source"),
        "gate_assembled": _gate_assembled,
        "final_types": _types,
        "csv_round_trip": _csv,
        "date_serials": lambda s, d: _t(s, d, "events").select("event_id", F.round(date_serial(F.col("ts")), 6).alias("serial")),
        "display_cells": _display,
        "standardise_report": _report,
        "suggest_standard": _suggest,
        "review_list": lambda s, d: labels.review_list(_t(s, d, "customer").withColumn("__row_id", F.col("c_custkey")), "c_name", {"customer#000000000": "a", " Customer#000000001 ": "b", "CUSTOMER#000000002": "c"}),
        "sink_upsert": _upsert_table,
        "sink_upsert_partitions": lambda s, d: _upsert_table(s, d, "c_nationkey"),
        "sink_upsert_text_keys": _upsert_text_keys,
        "donor_first": _full(gapfill={"donor_strategy": "first"}),
        "donor_previous": _full(gapfill={"donor_strategy": "previous"}),
        "donor_nearest": _full(gapfill={"donor_strategy": "nearest"}),
        "donor_chain_levels": _full(gapfill={"match_chain": chain}),
        "donor_prefer_new": _full(gapfill={"prefer": "new"}),
        "fill_formula": _full(gapfill={"rules": [{"column": "price", "type": "formula", "expr": "ROUND([donor.price] * 1.1, 2)"}]}),
        "derived_columns": _full(derived_columns=derived),
        "id_sequence": _full(gapfill={"id_policy": {"column": "order_id", "mode": "sequence", "start": 900001}}),
        "id_prefix": _full(gapfill={"id_policy": {"column": "order_id", "mode": "unique", "prefix": "F-", "start": 1}}),
        "out_dependency_order": lambda s, d: run(s, d, output_columns=[{"name": "double_price", "source": {"type": "formula", "expr": "[out.base] * 2"}}, {"name": "base", "source": {"type": "formula", "expr": "COALESCE([new.price], [donor.price])"}}, {"name": "nation", "source": {"type": "grid", "column": "nation"}}, {"name": "segment", "source": {"type": "grid", "column": "segment"}}, {"name": "period", "source": {"type": "grid", "column": "DATE"}}]).output.drop("SOURCE", "FILL BASIS"),
        "blank_profile": lambda s, d: run(s, d, grid={"dedupe": {"strategy": "first"}}, gapfill={"rules": [{"column": "price", "type": "blank"}, {"column": "order_id", "type": "blank"}]}).blank_columns().filter("column in ('price', 'order_id')").select(F.col("column").alias("column_name"), "blanks", "pct", "actual_blanks", "filled_blanks"),
        "issues_capped": _issues,
        "gate_clean": _gate(0),
        "gate_quarantine": _gate(1),
        "rule_in_master": lambda s, d: quality.member_flags(_t(s, d, "customer").withColumn("segment", F.concat(F.lit(" "), F.lower("c_mktsegment"))), "segment", inputs(s, d).master.filter("segment <> 'BUILDING'"), "segment", "known").select("c_custkey", "known"),
        "standardise_map": _standardise("map"),
        "standardise_add": _standardise("add"),
        "value_counts_unmatched": lambda s, d: labels.unmatched(
            _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("__row_id", F.col("o_orderkey")),
            _t(s, d, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit(" "), F.lower("c_name")).alias("c_name"), F.col("c_custkey").alias("__row_id")), "c_name", "c_name",
        ).select(F.col("value").alias("label"), F.col("rows").alias("n")),
        "column_profile": lambda s, d: labels.profile(_t(s, d, "customer")).select(F.col("column").alias("column_name"), "non_null", "nulls", "distinct_values"),
        "value_overlap": lambda s, d: labels.overlaps(_t(s, d, "part").filter("p_size > 25").select("p_name", "p_brand"), _t(s, d, "part").filter("p_size <= 40").select("p_name", "p_brand")),
        "column_samples": _samples,
        "standardise_unmatched": _unmatched,
        "value_map_suggestion": _value_maps,
        "key_pairs": lambda s, d: labels.key_pairs(_t(s, d, "nation").select("n_name", "n_nationkey", "n_regionkey")).select(F.col("left").alias("left_name"), F.col("right").alias("right_name"), F.col("rows").alias("n")),
        "upsert_idempotent": _upsert,
        "append_skip_dates": _append,
        "events_grid": _events_grid,
        "dedupe_overrides": lambda s, d: _dedupe("sum", {"v": "last", "status": "first", "tax": "sum"})(s, d).withColumn("tax", F.round("tax", 4)),
        "duplicate_count": lambda s, d: dedupe.duplicate_count(_t(s, d, "lineitem"), ["l_partkey", "l_returnflag"]),
    }
    for op, value in (("eq", "building"), ("ne", "BUILDING "), ("in", ["Building", "machinery"])):
        out[f"grid_master_filter_{op}"] = lambda s, d, op=op, value=value: _named(run(s, d, grid={"master_filter": {"column": "segment", "op": op, "value": value}}).output).groupBy("segment", "source").agg(F.count("*").alias("n"))
    out["grid_master_filter_gt"] = lambda s, d: _named(run(s, d, grid={"master_filter": {"column": "region", "op": "gt", "value": 2}}).output).groupBy("region", "source").agg(F.count("*").alias("n"))
    out |= {k: _formula(e) for k, (e, _) in FORMULAS.items()}
    out |= {f"rule_{k}": _rule(r) for k, (r, _) in _RULES.items()}
    out |= {f"dedupe_{k}": _dedupe(k) for k in _DEDUPES}
    return out


def oracle_sql() -> dict[str, str]:
    key = "row_id + 100000000 * date_diff('day', DATE '1970-01-01', period)"
    last = _sql(_static("arg_max", key))
    filtered = lambda cond, by: f"WITH {_BASE} SELECT g.{by}, CASE WHEN n.nation IS NULL THEN 'FILLED' ELSE 'ACTUAL' END AS source, count(*) AS n FROM g LEFT JOIN n ON n.nation = g.nation AND n.segment = g.segment AND n.period = g.period WHERE {cond} GROUP BY ALL"
    nearest = "SELECT nation, segment, period AS at_period, price, order_id, 'nation + segment' AS basis FROM (SELECT x.nation, x.segment, x.period, h.price, h.order_id, row_number() OVER (PARTITION BY x.nation, x.segment, x.period ORDER BY abs(date_diff('day', h.period, x.period)), h.period, h.row_id DESC) AS r FROM g x JOIN h ON h.nation = x.nation AND h.segment = x.segment) WHERE r = 1"
    new_pool = "SELECT m2.nation, m2.segment, coalesce(a.price, b.price) AS price, coalesce(a.order_id, b.order_id) AS order_id, b.basis FROM m m2 LEFT JOIN (SELECT nation, segment, arg_max(price, order_id + 100000000 * date_diff('day', DATE '1970-01-01', period)) AS price, arg_max(order_id, order_id + 100000000 * date_diff('day', DATE '1970-01-01', period)) AS order_id FROM n GROUP BY ALL) a ON a.nation = m2.nation AND a.segment = m2.segment LEFT JOIN (" + _static("arg_max", key) + ") b ON b.nation = m2.nation AND b.segment = m2.segment"
    by_segment = f"SELECT m2.nation, m2.segment, b.price, b.order_id, 'segment' AS basis FROM m m2 JOIN (SELECT segment, arg_max(price, {key}) AS price, arg_max(order_id, {key}) AS order_id FROM h GROUP BY ALL) b ON b.segment = m2.segment"
    seq = "row_number() OVER (PARTITION BY source ORDER BY grid_id)"
    numbered = _sql(_static("arg_max", key), more=", g.grid_id")
    columns = "nation, segment, period, price, {} AS order_id, region, source, fill_basis"
    upserted = "SELECT c_custkey, round(c_acctbal + CASE WHEN c_nationkey >= 10 THEN 1 ELSE 0 END, 2) AS c_acctbal FROM customer"
    newer = new_pool.replace("coalesce(a.order_id, b.order_id)", "b.order_id")
    with_id = lambda value: f"SELECT {columns.format(f'CASE WHEN source = {chr(39)}FILLED{chr(39)} THEN {value} ELSE order_id END')} FROM ({last})"
    overlap = lambda c: f"SELECT '{c}' AS \"left\", '{c}' AS \"right\", round((SELECT count(*) FROM (SELECT DISTINCT {c} FROM part WHERE p_size > 25 INTERSECT SELECT DISTINCT {c} FROM part WHERE p_size <= 40)) / least((SELECT count(DISTINCT {c}) FROM part WHERE p_size > 25), (SELECT count(DISTINCT {c}) FROM part WHERE p_size <= 40)), 6) AS overlap"
    out = {
        "grid_complete": last,
        "donor_undated": f"SELECT * EXCLUDE (period) FROM ({_sql(_static('arg_max', 'row_id'))})",
        "grid_explicit_dates": f"WITH {_BASE} SELECT m.nation, m.segment, d.period, CASE WHEN n.nation IS NULL THEN 'FILLED' ELSE 'ACTUAL' END AS source FROM m CROSS JOIN (VALUES (DATE '1998-02-01'), (DATE '1998-05-01'), (DATE '2001-01-01')) d(period) LEFT JOIN n ON n.nation = m.nation AND n.segment = m.segment AND n.period = d.period",
        "fill_coalesce": _sql(newer),
        "fill_pool": f"SELECT nation, segment, period, CASE WHEN source = 'FILLED' THEN 'historical' END AS fill_pool FROM ({last})",
        "id_blank": with_id("NULL"),
        "id_constant": with_id("-7"),
        "id_donor": with_id("order_id"),
        "grid_stats": f"WITH {_BASE} SELECT count(*) AS combinations, (SELECT count(DISTINCT period) FROM n0) AS dates, count(*) * (SELECT count(DISTINCT period) FROM n0) AS expected_rows, (SELECT count(*) FROM n) AS new_rows FROM m",
        "dropped_variants": f"WITH {_BASE} SELECT (SELECT count(*) FROM n0) - (SELECT count(*) FROM n) AS dropped_variants",
        "preview_cells": f"SELECT nation, segment, period, price, source FROM ({_sql(_static('arg_max', key), more=', g.grid_id')}) WHERE grid_id < 200",
        "gate_assembled": "SELECT c_custkey, c_acctbal, 'c_acctbal: above maximum 9000.0' AS qc_reason FROM customer WHERE c_acctbal > 9000",
        "final_types": "SELECT p_partkey AS part_key, lpad(CAST(p_size AS VARCHAR), 3, '0') AS size_code, round(p_retailprice, 2) AS price, p_name, CAST(DATE '2024-01-01' + CAST(p_size AS INTEGER) AS DATE) AS day FROM part",
        "csv_round_trip": "SELECT p_partkey AS part_key, p_name || ';' || chr(10) || p_brand AS label, lpad(CAST(p_size AS VARCHAR), 3, '0') AS size_code, round(p_retailprice, 2) AS price, CAST(p_size AS VARCHAR) || '\" ' || p_type AS kind FROM part",
        "date_serials": "SELECT event_id, round(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) + (epoch_us(ts) % 86400000000) / 86400000000.0, 6) AS serial FROM events",
        "display_cells": "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS placed FROM orders UNION ALL SELECT event_id, value, CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END FROM events",
        "standardise_report": f"WITH {_BASE} SELECT 'nation' AS new_column, 'nation' AS master_column, (SELECT count(DISTINCT nation) FROM n0) AS new_values, (SELECT count(DISTINCT nation) FROM m) AS master_values, (SELECT count(DISTINCT nation) FROM n0) AS matched, false AS skipped UNION ALL SELECT 'segment', 'segment', (SELECT count(DISTINCT segment) FROM n0), (SELECT count(DISTINCT segment) FROM m), (SELECT count(DISTINCT segment) FROM n0 WHERE segment NOT IN ('BUILDING', 'MACHINERY')), false UNION ALL SELECT 'price', 'region', 0, 0, 0, true",
        "review_list": "SELECT c_name AS value FROM customer WHERE c_custkey >= 3 ORDER BY c_custkey LIMIT 200",
        "gap_rows": f"SELECT * FROM ({last}) WHERE source = 'FILLED'",
        "excluded_anti": f"WITH {_BASE} SELECT order_id, nation, segment FROM n WHERE segment = 'BUILDING'",
        "grid_range_dates": f"WITH {_BASE} SELECT m.nation, m.segment, CAST(d.period AS DATE) AS period, CASE WHEN n.nation IS NULL THEN 'FILLED' ELSE 'ACTUAL' END AS source FROM m CROSS JOIN (SELECT unnest(range(DATE '1998-01-01', DATE '1998-01-11', INTERVAL 1 DAY)) AS period) d LEFT JOIN n ON n.nation = m.nation AND n.segment = m.segment AND n.period = d.period",
        "gapfill_off": f"SELECT * FROM ({last}) WHERE source = 'ACTUAL'",
        "donor_first": _sql(_static("arg_min", key)),
        "donor_previous": _sql(_ASOF["previous"]),
        "donor_nearest": _sql(nearest),
        "donor_chain_levels": _sql(by_segment),
        "donor_prefer_new": _sql(new_pool),
        "fill_formula": _sql(_static("arg_max", key), price="CASE WHEN n.nation IS NULL THEN round_even(d.price * 1.1 * 100, 0) / 100 ELSE n.price END"),
        "derived_columns": f"SELECT *, round_even(price / 12 * 100, 0) / 100 AS per_unit FROM ({last})",
        "id_sequence": f"SELECT {columns.format(f'CASE WHEN source = {chr(39)}FILLED{chr(39)} THEN 900000 + {seq} ELSE order_id END')} FROM ({numbered})",
        "id_prefix": f"SELECT {columns.format(f'CASE WHEN source = {chr(39)}FILLED{chr(39)} THEN {chr(39)}F-{chr(39)} || {seq} ELSE CAST(order_id AS VARCHAR) END')} FROM ({numbered})",
        "out_dependency_order": f"SELECT price * 2 AS double_price, price AS base, nation, segment, period FROM ({last})",
        "blank_profile": f"SELECT c AS column_name, count(*) AS blanks, round(100.0 * count(*) / (SELECT count(*) FROM ({last})), 1) AS pct, CAST(0 AS BIGINT) AS actual_blanks, count(*) AS filled_blanks FROM ({last}) CROSS JOIN (VALUES ('price'), ('order_id')) v(c) WHERE source = 'FILLED' GROUP BY c",
        "issues_capped": """WITH b AS (
  SELECT 0 AS ix, c_custkey, 'c_acctbal' AS col, 'non_negative' AS rule, false AS blocking, c_acctbal AS v, 'negative value' AS problem FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 1, c_custkey, 'c_acctbal', 'max', false, c_acctbal, 'above maximum 9000.0' FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT 2, c_custkey, 'c_nationkey', 'unique', true, c_nationkey, 'duplicate value' FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY ix) AS n FROM b)
SELECT c_custkey + 2 AS issue_row, col AS issue_column, rule, blocking, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS issue_value, problem FROM r WHERE r <= 100
UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), col, rule, blocking, CAST(NULL AS VARCHAR), (n - 100) || ' more rows' FROM r WHERE n > 100""",
        "gate_clean": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 9000",
        "gate_quarantine": "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'c_acctbal: negative value' ELSE 'c_acctbal: above maximum 9000.0' END AS qc_reason FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000",
        "rule_in_master": "SELECT c_custkey, c_mktsegment <> 'BUILDING' AS known FROM customer",
        "standardise_map": f"WITH {_BASE} SELECT segment, count(*) AS n FROM n0 GROUP BY ALL",
        "standardise_add": f"WITH {_BASE} SELECT segment, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'building trade', count(DISTINCT nation) FROM n0 WHERE segment = 'BUILDING'",
        "value_counts_unmatched": "SELECT c_name AS label, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal <= 5000 GROUP BY ALL",
        "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
        "value_overlap": overlap("p_name") + " UNION ALL " + overlap("p_brand"),
        "column_samples": " UNION ALL ".join(f"SELECT '{n}' AS column_name, count({e}) AS non_null, count(*) - count({e}) AS nulls, count(DISTINCT {e}) AS distinct_values, array_to_string(list(CAST({e} AS VARCHAR) ORDER BY c_custkey) FILTER (WHERE {e} IS NOT NULL)[1:3], '|') AS samples FROM customer" for n, e in (("c_name", "CASE WHEN c_custkey % 4 > 1 THEN c_name END"), ("c_nationkey", "c_nationkey"), ("c_mktsegment", "c_mktsegment"))),
        "standardise_unmatched": f"WITH {_BASE} SELECT 'segment' AS new_column, 'segment' AS master_column, segment || 'S' AS value, count(*) AS n, 'map' AS action, segment AS standard, round(2.0 * length(segment) / (2 * length(segment) + 1), 3) AS confidence FROM n0 WHERE price > 200000 GROUP BY segment",
        "value_map_suggestion": """WITH s AS (SELECT DISTINCT c_nationkey AS k FROM customer), m AS (SELECT count(*) AS n, count(CASE WHEN k < 20 THEN 1 END) AS covers FROM s)
SELECT 'nation' AS new_column, 'nation' AS target, 'codes' AS sheet, 'code' AS from_column, 'name' AS to_column, covers, CAST(0 AS DOUBLE) AS before, round(covers / n, 3) AS after, round(covers / n, 3) AS gain FROM m""",
        "key_pairs": "SELECT 'n_name' AS left_name, 'n_nationkey' AS right_name, count(*) AS n FROM nation UNION ALL SELECT 'n_nationkey', 'n_regionkey', count(*) FROM nation",
        "upsert_idempotent": upserted,
        "sink_upsert": upserted,
        "sink_upsert_partitions": upserted,
        "sink_upsert_text_keys": """SELECT CASE WHEN c_nationkey <> 7 THEN lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END AS area, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code,
 round(c_acctbal + CASE WHEN c_nationkey >= 10 THEN 10 WHEN c_nationkey >= 5 THEN 5 ELSE 0 END, 2) AS balance FROM customer""",
        "append_skip_dates": "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders), p AS (SELECT * FROM o WHERE order_date < DATE '1997-06-15') SELECT * FROM p UNION ALL SELECT * FROM o WHERE order_date NOT IN (SELECT order_date FROM p)",
        "events_grid": "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS \"user\", event_type AS kind, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT \"user\" FROM e) CROSS JOIN (SELECT DISTINCT kind FROM e) CROSS JOIN (SELECT DISTINCT day FROM e)) SELECT g.*, round(coalesce(e.value, 0), 4) AS value, CASE WHEN e.kind IS NULL THEN 'FILLED' ELSE 'ACTUAL' END AS source FROM g LEFT JOIN e USING (\"user\", kind, day)",
        "duplicate_count": "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag)",
        "grid_master_filter_eq": filtered("g.segment = 'BUILDING'", "segment"),
        "grid_master_filter_ne": filtered("g.segment <> 'BUILDING'", "segment"),
        "grid_master_filter_in": filtered("g.segment IN ('BUILDING', 'MACHINERY')", "segment"),
        "grid_master_filter_gt": filtered("g.region > 2", "region"),
    }
    lines = "(SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS k, *, CASE WHEN l_discount > 0.03 THEN l_quantity END AS v FROM lineitem)"
    group = lambda v: f"SELECT l_partkey, l_returnflag, round({v}, 4) AS v, arg_max(l_linestatus, k) AS status, max(l_tax) AS tax FROM {lines} GROUP BY ALL"
    out |= {f"dedupe_{k}": group(v) for k, v in _DEDUPES.items()} | {"dedupe_overrides": group("arg_max(v, k)").replace("arg_max(l_linestatus, k)", "arg_min(l_linestatus, k)").replace("max(l_tax)", "round(sum(l_tax), 4)")}
    for k, (_, sql) in FORMULAS.items():
        text = k in ("formula_text", "formula_compare", "formula_pad", "formula_proper")
        out[k] = f"SELECT o_orderkey, {sql if text else f'round({sql}, 6)'} AS result FROM (SELECT *, o_custkey % 100 AS qty FROM orders)"
    out |= {f"rule_{k}": f"SELECT c_custkey, {sql} AS breach FROM customer" for k, (_, sql) in _RULES.items()}
    return out

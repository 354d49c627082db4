"""The densify-and-fill query: configuration and three tables to one lazy plan.

new (transactions), master (the valid combinations) and historical (donor rows) become
one wide table with a struct by namespace (new, master, donor, new_donor, grid); every
output column is an expression over it. Nothing runs until a result is read, but that an
input without row numbers (__row_id) is written once with them, since all that is first
or last of its rows must mean the same in every part of the plan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import FormulaError, Value, compile_formula, literal, references
from ..functions.keys import kind_of, num, trim_ws
from ..operators import dedupe as dedupe_op
from ..operators import donors, grid, identity, labels, quality
from ..scratch import discard, materialise

NAMESPACES = ("new", "master", "donor", "new_donor", "grid", "out")


@dataclass
class Inputs:
    new: DataFrame
    master: DataFrame
    historical: DataFrame


@dataclass
class Result:
    output: DataFrame
    excluded: DataFrame
    rules: list[quality.Rule]
    unevaluable: list[tuple[dict, str]]
    additions: DataFrame | None
    checked: DataFrame
    columns: list[str]
    warnings: list[str] = field(default_factory=list)
    stats: DataFrame | None = None
    variants: DataFrame | None = None
    scratch: list[DataFrame] = field(default_factory=list)

    def saved(self) -> "Result":
        """The result with its rows written once, for callers that read it several times
        (output, issues, gate and counts each run the plan otherwise)."""
        checked = materialise(self.checked, "grid-checked")
        return replace(self, checked=checked, output=checked.select(*[F.col(f"`{c}`") for c in self.columns]), scratch=[*self.scratch, checked])

    def close(self) -> None:
        """Removes the tables that the result wrote; nothing can be read after it."""
        discard(*self.scratch)

    def typed(self, compat: bool = False) -> DataFrame:
        return final_types(self.output, compat)

    def issues(self) -> DataFrame:
        return quality.issues(self.checked, self.rules)

    def gate(self) -> tuple[DataFrame, DataFrame]:
        clean, bad = quality.gate(self.checked, self.rules)
        names = [F.col(f"`{c}`") for c in self.columns]
        return clean.select(*names), bad.select("QC_REASON", *names)

    def blank_columns(self) -> DataFrame:
        return quality.blank_profile(self.checked, self.columns, ~F.col("__gap"))

    def counts(self) -> DataFrame:
        return self.checked.agg(F.count("*").alias("rows"), F.count_if(~F.col("__gap")).alias("actual"), F.count_if("__gap").alias("filled"))


def load_config(text: str) -> dict:
    return json.loads(text)


def dump_config(config: dict) -> str:
    return json.dumps(config, indent=1, sort_keys=True)


def rename_output(config: dict, old: str, new: str) -> dict:
    """The configuration with an output column renamed wherever it is named."""
    def walk(x):
        if isinstance(x, dict):
            return {k: (new if k in ("column", "name") and v == old and not ("type" in x and x["type"] in NAMESPACES[:4]) else walk(v)) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return x.replace(f"[out.{old}]", f"[out.{new}]") if isinstance(x, str) else x

    return walk(config)


def remove_output(config: dict, name: str) -> dict:
    return config | {"output_columns": [c for c in config.get("output_columns", []) if c["name"] != name]}


def move_output(config: dict, name: str, to: int) -> dict:
    columns = list(config.get("output_columns", []))
    at = next(i for i, c in enumerate(columns) if c["name"] == name)
    columns.insert(to, columns.pop(at))
    return config | {"output_columns": columns}


def order_like(config: dict, template: list[str]) -> dict:
    """Output columns in the template's order; others stay in their order, last."""
    rank = {name: i for i, name in reversed(list(enumerate(template)))}
    return config | {"output_columns": sorted(config.get("output_columns", []), key=lambda c: rank.get(c["name"], len(template)))}


def fill_presets(column: str, prefer: str = "historical") -> dict[str, dict]:
    """Fill rules by name for a column: as it is, from a pool, with noise, of the master, zero."""
    pools = ["new_donor", "donor"] if prefer == "new" else ["donor", "new_donor"]
    best = "COALESCE(" + ", ".join(f"[{p}.{column}]" for p in pools) + ")"
    return {
        "asis": {"type": "default"},
        "fromnew": {"type": "new_donor", "column": column},
        "fromhist": {"type": "donor", "column": column},
        "jitter1": {"type": "formula", "expr": f"{best} * RANDBETWEEN(99,101) / 100"},
        "jitter5": {"type": "formula", "expr": f"ROUND({best} * RANDBETWEEN(95,105) / 100, 2)"},
        "master": {"type": "master", "column": column},
        "zero": {"type": "const", "value": 0},
    }


def final_types(df: DataFrame, compat: bool = False) -> DataFrame:
    """Text columns whose every value is a number become bigint (all whole) or double;
    those of dates become dates; columns without values stay. A column with a number
    like 007 stays text unless compat. One aggregation decides all columns."""
    texts = [f.name for f in df.schema if kind_of(f.dataType) == "text"]
    if not texts:
        return df
    col = lambda c: F.col(f"`{c}`")
    facts = lambda c: F.array(F.count(col(c)), F.count(num(col(c))), F.count_if((num(col(c)) == F.floor(num(col(c)))) & (F.abs(num(col(c))) < 2.0**63)), F.count(col(c).try_cast("date")), F.count_if(col(c).rlike(r"^\s*[+-]?0[0-9]")))
    stats = dict(zip(texts, df.agg(F.array(*[facts(c) for c in texts])).first()[0]))

    def typed(c: str) -> Column:
        n, numbers, whole, days, zeros = stats.get(c, [0] * 5)
        if n and numbers == n and (compat or not zeros):
            # Whole numbers go by their digits: a double would lose those beyond 2^53.
            return F.coalesce(trim_ws(col(c)).try_cast("bigint"), num(col(c)).cast("bigint")).alias(c) if whole == n else num(col(c)).alias(c)
        return col(c).try_cast("date").alias(c) if n and days == n and not numbers else col(c)

    return df.select(*[typed(c) for c in df.columns])


def with_row_id(df: DataFrame) -> DataFrame:
    """Row numbers in the order of reading. They are written once, as a plan that is
    computed again may number its rows otherwise."""
    return df if "__row_id" in df.columns else materialise(df.withColumn("__row_id", F.monotonically_increasing_id()), "grid-input")


def _formulas(spec: dict | None) -> list[str]:
    if not spec:
        return []
    return ([spec["expr"]] if spec.get("type") == "formula" else []) + [e for s in spec.get("sources", []) for e in _formulas(s)]


def evaluation_order(columns: list[dict], rules: dict[str, dict]) -> list[dict]:
    """Columns after those that they read; a cycle is an error that names it."""
    by_name = {c["name"].lower(): c for c in columns}
    needs = {}
    for c in columns:
        refs = [r for e in _formulas(c.get("source")) + _formulas(rules.get(c["name"]) or c.get("fill")) for r in references(e)]
        names = [r.split(".", 1)[1] if r.lower().startswith("out.") else r if "." not in r else "" for r in refs]
        needs[c["name"]] = [by_name[n.lower()]["name"] for n in names if n.lower() in by_name and n.lower() != c["name"].lower()]
    done, out = set(), []

    def visit(name: str, path: list[str]) -> None:
        if name in path:
            raise ValueError("columns need each other: " + " -> ".join([*path[path.index(name) :], name]))
        if name in done:
            return
        for other in needs[name]:
            visit(other, [*path, name])
        done.add(name)
        out.append(by_name[name.lower()])

    for c in columns:
        visit(c["name"], [])
    return out


class _Scope:
    """Resolves references and column specifications against the wide table."""

    def __init__(self, wide: DataFrame, prefer: str):
        self.schema = {ns: {f.name: f for f in wide.schema[ns].dataType} for ns in NAMESPACES[:5]}
        self.out: dict[str, Value] = {}
        self.prefer = prefer

    def value(self, ns: str, column: str) -> Value | None:
        if ns == "out":
            return next((v for k, v in self.out.items() if k.lower() == column.lower()), None)
        found = next((f for n, f in self.schema[ns].items() if n.lower() == column.lower()), None)
        return Value(F.col(ns)[found.name], kind_of(found.dataType)) if found else None

    def resolve(self, ref: str) -> Value:
        ns, _, column = ref.partition(".")
        if column and ns.lower() in NAMESPACES:
            found = self.value(ns.lower(), column)
            if found is None:
                raise FormulaError(f"unknown column {ref}")
            return found
        for ns in ("out", "new", "master", "donor", "new_donor", "grid"):
            if (found := self.value(ns, ref)) is not None:
                return found
        raise FormulaError(f"unknown column {ref}")

    def available(self) -> list[str]:
        return [f"{ns}.{c}" for ns in NAMESPACES[:5] for c in self.schema[ns]] + [f"out.{c}" for c in self.out]

    def spec(self, spec: dict | None) -> Value:
        kind = (spec or {}).get("type")
        if kind in ("const", "constant"):
            raw = spec.get("value")
            if isinstance(raw, str):
                try:
                    raw = float(raw) if raw.strip() and raw.strip().lstrip("+-")[0] in "0123456789." else raw
                except ValueError:
                    pass
            return literal(raw)
        if kind == "formula":
            return compile_formula(spec["expr"], self.resolve)
        if kind == "coalesce":
            out = literal(None)
            for s in spec.get("sources", []):
                out = _merge(out, self.spec(s))
            return out
        if kind in NAMESPACES:
            return self.value(kind, spec["column"]) or literal(None)
        return literal(None)

    def default_fill(self, name: str) -> Value:
        own = self.value("grid", name)
        if own is not None:
            return own
        pools = ("donor", "new_donor", "master") if self.prefer == "historical" else ("new_donor", "donor", "master")
        out = literal(None)
        for ns in pools:
            if (v := self.value(ns, name)) is not None:
                out = _merge(out, v)
        return out


def _merge(a: Value, b: Value) -> Value:
    if a.kind == "null":
        return b
    if b.kind == "null" or a.kind == b.kind:
        return Value(F.coalesce(a.col, b.col), a.kind)
    return Value(F.coalesce(*[F.when(v.col.isNotNull(), v.text) for v in (a, b)]), "text")


def _switch(is_gap: Column, real: Value, fill: Value) -> Value:
    if real.kind == fill.kind or "null" in (real.kind, fill.kind):
        return Value(F.when(is_gap, fill.col).otherwise(real.col), real.kind if fill.kind == "null" else fill.kind)
    texts = [F.when(v.col.isNotNull(), v.text) for v in (fill, real)]
    return Value(F.when(is_gap, texts[0]).otherwise(texts[1]), "text")


def build_output(inputs: Inputs, config: dict) -> Result:
    cfg, fill, warnings = config.get("grid", {}), config.get("gapfill", {}), []
    dims = cfg.get("master_dims") or []
    if not dims:
        raise ValueError("grid.master_dims is needed")
    new, master, hist = map(with_row_id, (inputs.new, inputs.master, inputs.historical))
    scratch = [df for df, given in zip((new, master, hist), (inputs.new, inputs.master, inputs.historical)) if df is not given]

    # Labels.
    roles = (config.get("column_roles") or {}).get("new", {})
    attributes = [a for a in config.get("attribute_map") or dims if roles.get(a["new"], "dimension") == "dimension"]
    allowed = {a["new"] for a in attributes}
    decisions = {c: d for c, d in (config.get("standardise_decisions") or {}).items() if c in allowed}
    new, master, additions = labels.apply_decisions(new, master, attributes, decisions)
    for m in config.get("value_maps") or []:
        if m.get("enabled", True):
            new = labels.value_map(new, m["column"], m["pairs"], m.get("keep_unmatched", True))

    # Dates, duplicates, the grid.
    date_column = cfg.get("new_date_column")
    new_cols, master_cols, hist_cols = ([c for c in df.columns if not c.startswith("__")] for df in (new, master, hist))
    new = grid.with_date(new, date_column)
    axis = grid.dates(new.sparkSession, new, cfg.get("date_mode", "from_new"), cfg.get("dates"), cfg.get("date_from"), cfg.get("date_to"))
    rule = cfg.get("dedupe") or {}
    keys = [d["new"] for d in dims if d["new"] in new.columns] + (["__date"] if date_column else [])
    overrides = (rule.get("overrides") or {}) | ({date_column: "first"} if date_column else {})
    new = dedupe_op.dedupe(new, keys, rule.get("strategy", "first"), overrides)
    f = cfg.get("master_filter")
    base = grid.master_filter(master, f["column"], f.get("op", "eq"), f.get("value")) if f else master
    dim_names = [d["master"] for d in dims]
    combos = grid.combinations(base, dim_names, master_cols)
    keys_only = grid.combination_keys(base, dim_names)
    size = grid.stats(new, keys_only, axis)
    if cfg.get("max_rows") and (rows := size.first()["expected_rows"]) > int(cfg["max_rows"]):
        raise ValueError(f"the grid has {rows} rows, more than grid.max_rows allows")
    new = grid.match_keys(new, [d["new"] for d in dims])
    placed = grid.placed(new, keys_only, axis, len(dims))
    out_of_grid = placed.filter("not __in_grid").select(*[F.col(f"`{c}`") for c in new_cols])
    twice = grid.variants(placed.filter("__in_grid"), len(dims))

    # Donors: by keys alone before the combinations meet the dates, by date after it.
    filling = fill.get("enabled", True)
    strategy, prefer, strict = fill.get("donor_strategy", "last"), fill.get("prefer", "historical"), bool(fill.get("strict_previous"))
    hist = grid.with_date(hist, fill.get("hist_date_column"))
    chains = (fill.get("match_chain") or donors.default_chain(dims, "hist"), fill.get("match_chain_new") or donors.default_chain(dims, "new")) if filling else ([], [])
    searches = [
        donors.Search(hist, chains[0], "hist", hist_cols, strategy, dim_names, "donor", strict),
        donors.Search(new, chains[1], "new", new_cols, strategy, dim_names, "new_donor", strict),
    ]
    # The gaps: cells without a transaction. Only their keys and dates look for donors.
    taken = placed.filter("__in_grid").select(*[f"__k{i}" for i in range(len(dims))], "__date").distinct()
    wanted = keys_only.crossJoin(axis.select("__date")).join(taken, [*(f"__k{i}" for i in range(len(dims))), "__date"], "left_anti")
    for search in searches:
        combos = search.static(combos)
    cells = grid.grid(combos, axis)
    if config.get("preview_limit"):
        cells = cells.orderBy("__grid_id").limit(int(config["preview_limit"]))
    for search in searches:
        cells = search.dated(cells, wanted)
        scratch += search.written
    wide = grid.attach_new(cells, new, len(dims), new_cols, "left" if filling else "inner").withColumn("__gap", F.col("new").isNull())
    for search in searches:
        wide = search.settle(wide, F.col("__gap"))
    alias = {"DATE": F.col("__date")} | {d["master"]: F.col("master")[d["master"]] for d in dims}
    # Field names are told apart without case.
    for name, c in [(d.get("hist") or d["master"], F.col("master")[d["master"]]) for d in dims] + [(fill.get("hist_date_column"), F.col("__date"))]:
        if name and name.lower() not in {n.lower() for n in alias}:
            alias[name] = c
    wide = wide.withColumn("grid", F.struct(*[c.alias(n) for n, c in alias.items()]))

    # Output columns, in the order that they need each other.
    scope, is_gap = _Scope(wide, prefer), F.col("__gap")
    rules = {}
    for r in fill.get("rules") or []:
        if r["column"].lower() in {n.lower() for n in alias} and r.get("type") in ("donor", "new_donor"):
            warnings.append(f"fill rule on {r['column']} dropped: the grid sets this column")
            continue
        rules[r["column"]] = {k: v for k, v in r.items() if k != "column"} | ({"column": r["from"]} if "from" in r else {"column": r["column"]})
    columns = config.get("output_columns") or [{"name": c, "source": {"type": "new", "column": c}} for c in hist_cols]
    for c in evaluation_order(columns, rules):
        source, own_rule = c.get("source") or {}, rules.get(c["name"]) or c.get("fill")
        try:
            value = scope.spec(source)
            default = scope.default_fill(c["name"])
            if own_rule:
                value = _switch(is_gap, value, scope.spec(own_rule))
            elif source.get("type") == "formula" and source.get("all_rows", True):
                value = _switch(is_gap, value, _merge(value, default))
            else:
                value = _switch(is_gap, value, default)
        except FormulaError as e:
            raise FormulaError(f"column {c['name']}: {e}") from None
        wide = wide.withColumn(f"__out_{len(scope.out)}", value.col)
        scope.out[c["name"]] = Value(F.col(f"__out_{len(scope.out)}"), value.kind if value.kind != "null" else "text")
    order = [c["name"] for c in columns]
    for d in config.get("derived_columns") or []:
        try:
            value = compile_formula(d["expr"], scope.resolve)
        except FormulaError as e:
            raise FormulaError(f"derived column {d['name']}: {e}") from None
        slot = f"__out_{len(scope.out)}"
        wide = wide.withColumn(slot, value.col)
        scope.out[d["name"]] = Value(F.col(slot), value.kind)
        order = [n for n in order if n != d["name"]]
        order.insert(d["position"] if d.get("position") is not None else len(order), d["name"])

    picked = [scope.out[n].col.alias(n) for n in order]
    pools = [F.when(F.col(f"{ns}_level").isNotNull(), F.lit(name)) for ns, name in (("donor", "historical"), ("new_donor", "new"))]
    pool = F.coalesce(*(pools if prefer == "historical" else pools[::-1]))
    policy = fill.get("id_policy") or {}
    id_column = policy.get("column")
    extra = [F.col("donor")[id_column].alias("__id_donor")] if policy.get("mode") == "donor" and id_column in hist_cols else []
    checked = wide.select("__grid_id", "__gap", *extra, *picked, F.col("donor_level").alias("__basis"), pool.alias("__pool"), *[F.col("master")[c].alias(f"__master_{c}") for c in {r.get("reference") for r in config.get("validations") or []} if c in master_cols])
    if id_column in order and id_column not in rules:
        checked = identity.apply(checked, id_column, policy, donor=F.col("__id_donor") if extra else None)
    if config.get("add_flag", True):
        flag = config.get("flag_column") or "SOURCE"
        checked = checked.withColumn(flag, F.when(is_gap, F.lit("FILLED")).otherwise(F.lit("ACTUAL"))).withColumn("FILL BASIS", F.col("__basis"))
        order = [n for n in order if n not in (flag, "FILL BASIS")] + [flag, "FILL BASIS"]
        if config.get("add_pool"):
            checked = checked.withColumn("FILL POOL", F.col("__pool"))
            order = [n for n in order if n != "FILL POOL"] + ["FILL POOL"]

    # Rules: in_master compares with the labels that the grid's rows carry.
    members, refs = {}, {c.removeprefix("__master_"): F.col(f"`{c}`") for c in checked.columns if c.startswith("__master_")}
    checked = quality.prepare(checked, [r for r in config.get("validations") or [] if r.get("column") in order])
    for i, r in enumerate(config.get("validations") or []):
        if r.get("type") == "in_master" and r.get("reference") in refs and r.get("column") in order:
            flag = f"__in_{i}"
            checked = quality.member_flags(checked, r["column"], base, r["reference"], flag)
            members[r["reference"]] = flag
    compiled, failed = quality.compile_rules(config.get("validations") or [], checked, refs, members)
    output = checked.select(*[F.col(f"`{n}`") for n in order])
    return Result(output, out_of_grid, compiled, failed, additions, checked, order, warnings, size, twice, scratch)


def suggest_config(inputs: Inputs) -> dict:
    """A starting configuration from the tables' names and labels."""
    new, master, hist = map(with_row_id, (inputs.new, inputs.master, inputs.historical))
    dims = labels.suggest_dims(master, new, hist)
    date = lambda df: next((f.name for f in df.schema if kind_of(f.dataType) == "date"), next((c for c in df.columns if "date" in c.lower()), None))
    names = [c for c in hist.columns if not c.startswith("__")]
    mapped = labels.suggest_column_map(names, new, hist)
    return {
        "grid": {"master_dims": dims, "new_date_column": date(new), "date_mode": "from_new", "dedupe": {"strategy": "first"}},
        "output_columns": [{"name": c, "source": {"type": "new", "column": mapped[c]} if c in mapped else {"type": "blank"}} for c in names],
        "gapfill": {"enabled": True, "donor_strategy": "last", "hist_date_column": date(hist), "prefer": "historical", "id_policy": {"column": labels.guess_id(hist), "mode": "blank"}},
        "attribute_map": labels.suggest_attributes(new, master),
        "validations": labels.suggest_validations(grid.kinds(hist), master.columns),
        "add_flag": True,
    }

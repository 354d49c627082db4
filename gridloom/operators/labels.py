"""Label standardisation, value maps, and suggestions for column maps and dimensions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import key, num, text, trim_ws
from . import similar
from .grid import kinds
from .names import LEAST_SIMILARITY, norm, score_names, similarity  # noqa: F401


def labels(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """(value, rows, first): trimmed, not empty."""
    v = trim_ws(text(F.col(f"`{column}`"), kinds(df)[column]))
    return df.select(v.alias(name), "__row_id").filter(F.col(name) != "").groupBy(name).agg(F.count("*").alias("rows"), F.min("__row_id").alias("first"))


def unmatched(new: DataFrame, master: DataFrame, new_column: str, master_column: str) -> DataFrame:
    """Labels of new that master has not, with their rows."""
    known = labels(master, master_column, "known").select(F.upper("known").alias("__k")).distinct()
    return labels(new, new_column).withColumn("__k", F.upper("value")).join(known, "__k", "left_anti").select("value", "rows")


def suggest(unknown: DataFrame, master: DataFrame, master_column: str, crosswalk: dict[str, str] | None = None, threshold: float = LEAST_SIMILARITY) -> DataFrame:
    """(value, rows, action, to, confidence, why) for unmatched labels: the crosswalk's
    standard if master has it, else the most similar one (the first of equals), else add.
    similar.best() finds these without comparing all pairs."""
    standards = labels(master, master_column, "label").select("label", "first")
    plain = F.pandas_udf(lambda s: s.map(norm), "string")
    left = unknown.select("value", plain("value").alias("x"))
    right = standards.withColumn("x", plain("label"))
    # Labels that read the same stand for their first one.
    named = right.groupBy("x").agg(F.min_by("label", "first").alias("to"))
    found = similar.best(left, right).join(named.withColumnRenamed("x", "y"), "y").select("x", F.struct("to", "score").alias("b"))
    best = left.join(found, "x").select("value", "b")
    pairs = [(str(k).strip().upper(), v) for k, v in (crosswalk or {}).items()]
    known = master.sparkSession.createDataFrame(pairs, "__k string, __to string").dropDuplicates(["__k"])
    held = standards.select(F.upper("label").alias("__u")).distinct()
    known = known.join(held, F.upper(trim_ws("__to")) == F.col("__u"), "left_semi")
    near = F.col("b.score") >= threshold
    fixed = F.col("__to")
    out = unknown.withColumn("__k", F.upper("value")).join(known, "__k", "left").join(best, "value", "left")
    why = F.when(fixed.isNotNull(), F.lit("listed in a crosswalk")).when(near, F.concat(F.floor(100 * F.col("b.score")).cast("string"), F.lit("% similar"))).otherwise(F.lit("nothing similar"))
    return out.select(
        "value", "rows", F.when(fixed.isNotNull() | near, F.lit("map")).otherwise(F.lit("add")).alias("action"),
        F.coalesce(fixed, F.when(near, F.col("b.to"))).alias("to"),
        F.when(fixed.isNotNull(), F.lit(1.0)).otherwise(F.round(F.coalesce("b.score", F.lit(0.0)), 3)).alias("confidence"), why.alias("why"),
    )


def report(new: DataFrame, master: DataFrame, pairs: list[dict], crosswalks: dict[str, dict[str, str]] | None = None, decisions: dict[str, dict[str, dict]] | None = None, roles: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """For pairs of columns (new, master): a summary (new_column, master_column,
    new_values, master_values, matched, skipped) and the unmatched labels with their
    decision, or a suggestion where there is none, by pair and value. Numeric columns are skipped unless
    roles declares them dimensions."""
    crosswalks, decisions, roles = crosswalks or {}, decisions or {}, roles or {}
    found_new, found_master = column_roles(new), column_roles(master)
    summary, rows, seen = None, None, []
    add = lambda a, b: b if a is None else a.unionByName(b)
    for p in pairs:
        a, b = p.get("new"), p.get("master")
        if a not in new.columns or b not in master.columns:
            continue
        head = [F.lit(a).alias("new_column"), F.lit(b).alias("master_column")]
        measures = "measure" in (found_new[a], found_master[b]) and roles.get(a) != "dimension"
        x, y = labels(new, a), labels(master, b, "label")
        if measures:
            summary = add(summary, new.sparkSession.range(1).select(*head, *[F.lit(0).cast("bigint").alias(c) for c in ("new_values", "master_values", "matched")], F.lit(True).alias("skipped")))
            continue
        other = unmatched(new, master, a, b)
        counts = x.agg(F.count("*").alias("new_values")).crossJoin(y.agg(F.count("*").alias("master_values"))).crossJoin(other.agg(F.count("*").alias("n")))
        summary = add(summary, counts.select(*head, "new_values", "master_values", (F.col("new_values") - F.col("n")).alias("matched"), F.lit(False).alias("skipped")))
        out = suggest(other, master, b, crosswalks.get(b))
        prior = [(k, d.get("action", "map"), d.get("to")) for k, d in decisions.get(a, {}).items()]
        if prior:
            chosen = new.sparkSession.createDataFrame(prior, "value string, __action string, __to string")
            out = out.join(chosen, "value", "left")
            taken = F.col("__action").isNotNull()
            out = out.select("value", "rows", F.coalesce("__action", "action").alias("action"), F.when(taken, F.col("__to")).otherwise(F.col("to")).alias("to"), F.when(taken, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(taken, F.lit("")).otherwise(F.col("why")).alias("why"))
        rows = add(rows, out.select(*head, "value", "rows", "action", "to", "confidence", "why", F.lit(len(seen)).alias("__pair")))
        seen.append(p)
    spark = new.sparkSession
    kinds_of_summary = "new_column string, master_column string, new_values bigint, master_values bigint, matched bigint, skipped boolean"
    kinds_of_rows = "new_column string, master_column string, value string, rows bigint, action string, to string, confidence double, why string"
    return summary if summary is not None else spark.createDataFrame([], kinds_of_summary), rows.orderBy("__pair", "value").drop("__pair") if rows is not None else spark.createDataFrame([], kinds_of_rows)


def review_list(df: DataFrame, column: str, mapping: dict[str, str], limit: int = 200) -> DataFrame:
    """(value): the first distinct labels that a map has no entry for."""
    known = df.sparkSession.createDataFrame([(str(k).strip().upper(),) for k in mapping], "__k string")
    return labels(df, column).withColumn("__k", F.upper("value")).join(known, "__k", "left_anti").orderBy("first").limit(limit).select("value")


def value_map(df: DataFrame, column: str, pairs: dict[str, str], keep_unmatched: bool = True) -> DataFrame:
    """Replace labels by a map whose keys are compared trimmed and in upper case."""
    if column not in df.columns or not pairs:
        return df
    mapping = df.sparkSession.createDataFrame([(str(k).strip().upper(), v) for k, v in pairs.items()], "__from string, __to string").dropDuplicates(["__from"])
    c, kind = F.col(f"`{column}`"), kinds(df)[column]
    joined = df.withColumn("__from", key(c, kind)).join(mapping, "__from", "left")
    other = F.when(c.isNotNull(), text(c, kind)) if keep_unmatched else F.lit(None).cast("string")
    return joined.withColumn(column, F.when(F.col("__to").isNotNull(), F.col("__to")).otherwise(other)).select(*[F.col(f"`{x}`") for x in df.columns])


def apply_decisions(new: DataFrame, master: DataFrame, attributes: list[dict], decisions: dict[str, dict[str, dict]]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(new, master, additions): map rewrites labels, add extends master by the distinct
    combinations that new has of them, exclude leaves them to fall out unmatched."""
    for column, choices in decisions.items():
        new = value_map(new, column, {k: d["to"] for k, d in choices.items() if d.get("action") == "map" and d.get("to")})
    pairs = [a for a in attributes if a["new"] in new.columns and a["master"] in master.columns]
    wanted = None
    for a in pairs:
        added = [str(k).strip().upper() for k, d in decisions.get(a["new"], {}).items() if d.get("action") == "add"]
        if added:
            hit = key(F.col(f"`{a['new']}`"), kinds(new)[a["new"]]).isin(added)
            wanted = hit if wanted is None else wanted | hit
    if wanted is None:
        return new, master, None
    additions = new.filter(wanted).groupBy(*[F.col(f"`{a['new']}`").cast(master.schema[a["master"]].dataType).alias(a["master"]) for a in pairs]).agg(F.min("__row_id").alias("__row_id"))
    top = master.agg(F.coalesce(F.max("__row_id"), F.lit(0)).alias("__top"))
    placed = additions.crossJoin(F.broadcast(top)).withColumn("__row_id", F.col("__row_id") + F.col("__top") + 1).drop("__top")
    return new, master.unionByName(placed, allowMissingColumns=True), additions.drop("__row_id")


def key_pairs(df: DataFrame, least_rows: int = 4) -> DataFrame:
    """Neighbouring columns that read as label and standard: (left, right, rows). Labels
    are counted by pair and value, which each task combines first."""
    names, by = [c for c in df.columns if not c.startswith("__")], kinds(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, rows bigint")
    shown = {c: trim_ws(text(F.col(f"`{c}`"), by[c])) for c in names}
    pair = lambda a, b: F.when((shown[a] != "") & (shown[b] != ""), F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lower(shown[a]).alias("k"), F.lower(shown[b]).alias("v")))
    cells = df.select(F.explode(F.array_compact(F.array(*[pair(a, b) for a, b in zip(names, names[1:])]))).alias("p")).select("p.*")
    counted = cells.groupBy("left", "right", "k").agg(F.count("*").alias("n"), F.count_if(F.col("k") == F.col("v")).alias("same"))
    flat = counted.groupBy("left", "right").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum("same").alias("same"))
    return flat.filter((F.col("rows") >= least_rows) & (F.col("keys") >= 0.9 * F.col("rows")) & (F.col("same") <= 0.95 * F.col("rows"))).select("left", "right", "rows")


#: Labels of a crosswalk, at most.
MOST_PAIRS = 1_000_000


def collect_crosswalks(sheet: DataFrame, master: DataFrame, least: float = 0.6) -> dict[str, dict[str, str]]:
    """Label to standard by master column, from neighbouring columns of a sheet whose
    right side is mostly in that column. The result is configuration; a sheet with more
    than MOST_PAIRS labels is none, and an error."""
    out: dict[str, dict[str, str]] = {}
    for pair in key_pairs(sheet).collect():
        right = labels(sheet, pair["right"], "v").select(F.upper("v").alias("v")).distinct()
        for column in (f.name for f in master.schema if f.dataType.typeName() == "string"):
            known = labels(master, column, "v").select(F.upper("v").alias("v")).distinct()
            share = right.join(known.withColumn("k", F.lit(1)), "v", "left").agg(F.avg(F.coalesce("k", F.lit(0)))).first()[0]
            if share is not None and share >= least:
                rows = sheet.select(key(F.col(f"`{pair['left']}`")).alias("k"), trim_ws(F.col(f"`{pair['right']}`").cast("string")).alias("v"), "__row_id").filter("k <> '' and v <> ''").groupBy("k").agg(F.max_by("v", "__row_id").alias("v")).limit(MOST_PAIRS + 1).collect()
                if len(rows) > MOST_PAIRS:
                    raise ValueError(f"{pair['left']}: more than {MOST_PAIRS} labels are no crosswalk")
                for r in rows:
                    out.setdefault(column, {}).setdefault(r["k"], r["v"])
    return out


def value_sets(df: DataFrame) -> DataFrame:
    """(column, v): the distinct normalised labels of all rows, by column."""
    by = kinds(df)
    norm_col = lambda c: trim_ws(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))
    names = [c for c in df.columns if not c.startswith("__")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), norm_col(text(F.col(f"`{c}`"), by[c])).alias("v")) for c in names])
    return df.select(F.explode(cells).alias("s")).select("s.*").filter("v <> ''").distinct()


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, overlap): shared labels by the smaller set, for all pairs of columns."""
    x = value_sets(a).select(F.col("column").alias("left"), "v")
    y = value_sets(b).select(F.col("column").alias("right"), "v")
    nx = x.groupBy("left").agg(F.count("*").alias("nx"))
    ny = y.groupBy("right").agg(F.count("*").alias("ny"))
    both = x.join(y, "v").groupBy("left", "right").agg(F.count("*").alias("n"))
    return both.join(nx, "left").join(ny, "right").select("left", "right", F.round(F.col("n") / F.least("nx", "ny"), 6).alias("overlap"))


def suggest_column_map(target: list[str], source: DataFrame, reference: DataFrame | None = None, threshold: float = 0.62) -> dict[str, str]:
    """The best source column for each target name, by names and shared labels."""
    shared = {(r["left"], r["right"]): r["overlap"] for r in overlaps(reference, source).collect()} if reference is not None else {}
    source_kinds, target_kinds, out = kinds(source), kinds(reference) if reference is not None else {}, {}
    for t in target:
        def score(s: str, t: str = t) -> float:
            if target_kinds.get(t) == "number" and source_kinds[s] == "text":
                return 0.0
            name, values = score_names(t, s), shared.get((t, s), 0.0)
            if target_kinds.get(t) == "text" and values < 0.15 and name < 0.95 and shared:
                return 0.0
            return max(name, 0.55 * name + 0.75 * values)

        ranked = [c for c in source.columns if not c.startswith("__")]
        if ranked and score(best := max(ranked, key=score)) >= threshold:
            out[t] = best
    return out


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """How many values each column has: counted by column and value, in one pass."""
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(names)])
    per = df.select(F.explode(cells).alias("c")).select("c.*").filter("v is not null").distinct().groupBy("i").agg(F.count("*").alias("n"))
    found = {r["i"]: r["n"] for r in per.collect()}
    return {c: found.get(i, 0) for i, c in enumerate(names)}


# Names of the columns that define a row, most wanted first.
PREFERRED_DIMS = ["city", "sku standard name", "sku", "product", "region"]


def _rank(name: str) -> int | None:
    plain = norm(name)
    if plain in PREFERRED_DIMS:
        return PREFERRED_DIMS.index(plain)
    return next((len(PREFERRED_DIMS) * 2 + i for i, p in enumerate(PREFERRED_DIMS) if p in plain), None)


def equal_shares(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float]:
    """For each pair of columns the share of rows whose labels are equal, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return {}
    by = kinds(df)
    label = {c: key(F.col(f"`{c}`"), by[c]) for c in names}
    row = df.agg(*[F.avg((label[a] == label[b]).cast("int")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[i] or 0.0 for i, p in enumerate(pairs)}


def suggest_dims(master: DataFrame, new: DataFrame, hist: DataFrame | None = None, most: int = 3) -> list[dict]:
    """Columns of master that define a row: texts of 2 labels or more, under a preferred
    name (or one that has it in it), at least half of whose labels new has in one column.
    A column that is equal to a better one in more than 95 % of the rows, or is joined
    to the same column of new, says the same again and is left out."""
    n, by = master.count(), kinds(master)
    named = [c for c, k in by.items() if k in ("text", "bool") and not c.startswith("__") and _rank(c) is not None]
    counts = distinct_counts(master, named)
    fit = [c for c in named if 2 <= counts[c] <= max(400, n / 2)]
    if not fit:
        return []
    pool = master.select("__row_id", *[F.col(f"`{c}`") for c in fit])

    def matches(df: DataFrame) -> dict[str, tuple[float, str]]:
        order = {c: i for i, c in enumerate(df.columns)}
        found: dict[str, tuple[float, str]] = {}
        rows = [r for r in overlaps(pool, df).collect() if kinds(df)[r["right"]] != "date"]
        for r in sorted(rows, key=lambda r: (-r["overlap"], order[r["right"]])):
            found.setdefault(r["left"], (r["overlap"], r["right"]))
        return found

    in_new, in_hist = matches(new), matches(hist) if hist is not None else {}
    ranked = sorted((c for c in fit if in_new.get(c, (0, ""))[0] >= 0.5), key=lambda c: (_rank(c), -in_new[c][0], fit.index(c)))
    shares = equal_shares(pool, ranked)
    chosen: list[str] = []
    for c in ranked:
        if all(in_new[c][1] != in_new[k][1] and max(shares.get((c, k), 0), shares.get((k, c), 0)) <= 0.95 for k in chosen):
            chosen.append(c)
    return [{"master": c, "new": in_new[c][1], "hist": in_hist[c][1] if c in in_hist else None if hist is not None else c} for c in chosen[:most]]


#: What a value map has to bring: more labels known by this share, and this share in all.
LEAST_GAIN, LEAST_KNOWN = 0.15, 0.6


def suggest_value_maps(new: DataFrame, master: DataFrame, sheets: dict[str, DataFrame]) -> DataFrame:
    """Crosswalks worth applying: (column, target, sheet, from_column, to_column, covers,
    before, after, gain). Neighbouring columns of a sheet are one if mapping a column of
    new by them raises the share of its labels that its partner in master (the column
    of the most similar name) knows by LEAST_GAIN, to LEAST_KNOWN at least. One a column,
    that of the largest gain."""
    spark = new.sparkSession
    schema = "column string, target string, sheet string, from_column string, to_column string, covers bigint, before double, after double, gain double"
    label = lambda df, c: F.upper(trim_ws(text(F.col(f"`{c}`"), kinds(df)[c])))

    def texts(df: DataFrame) -> list[str]:
        names = [c for c, k in kinds(df).items() if k in ("text", "bool") and not c.startswith("__")]
        return [c for c, n in distinct_counts(df, names).items() if 1 < n <= 500]

    def melted(df: DataFrame, names: list[str], name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias(name), label(df, c).alias("v")) for c in names])
        return df.select(F.explode(cells).alias("c")).select("c.*").filter("v <> ''").distinct()

    ours, theirs = texts(new), texts(master)
    partner = {c: max(theirs, key=lambda m: score_names(c, m)) for c in ours if theirs}
    partner = {c: m for c, m in partner.items() if score_names(c, m) >= 0.7}
    pairs = [(name, r["left"], r["right"]) for name, df in sheets.items() for r in key_pairs(df).collect()]
    if not partner or not pairs:
        return spark.createDataFrame([], schema)
    # Of the sheets, one table of what each pair of columns maps; a label's last row counts.
    maps = None
    for i, (name, a, b) in enumerate(pairs):
        df = sheets[name]
        rows = df.select(F.lit(i).alias("pair"), label(df, a).alias("v"), trim_ws(text(F.col(f"`{b}`"), kinds(df)[b])).alias("to"), "__row_id").filter("v <> '' and to <> ''")
        part = rows.groupBy("pair", "v").agg(F.upper(F.max_by("to", "__row_id")).alias("to"))
        maps = part if maps is None else maps.unionByName(part)
    partners = spark.createDataFrame(sorted(partner.items()), "column string, target string")
    source = melted(new, sorted(partner), "column")
    known = melted(master, sorted(set(partner.values())), "target").join(partners, "target").select("column", F.col("v").alias("m"), F.lit(1).alias("known"))
    share = lambda df: df.join(known, [*(c for c in ("column", "m"))], "left").groupBy(*[c for c in df.columns if c != "m"]).agg(F.avg(F.coalesce("known", F.lit(0))).alias("share"))
    before = share(source.withColumnRenamed("v", "m")).withColumnRenamed("share", "before")
    every = source.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))))
    mapped = every.join(maps, ["pair", "v"], "left").withColumn("m", F.coalesce("to", "v"))
    covers = mapped.groupBy("column", "pair").agg(F.count("to").alias("covers"))
    after = share(mapped.select("column", "pair", "m").distinct()).withColumnRenamed("share", "after")
    gains = after.join(before, "column").join(covers, ["column", "pair"]).withColumn("gain", F.col("after") - F.col("before"))
    worth = gains.filter((F.col("gain") >= LEAST_GAIN) & (F.col("after") >= LEAST_KNOWN))
    top = worth.groupBy("column").agg(F.max_by(F.struct("pair", "covers", "before", "after", "gain"), F.struct("gain", -F.col("pair"))).alias("b")).select("column", "b.*")
    where = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair int, sheet string, from_column string, to_column string")
    rounded = [F.round(c, 3).alias(c) for c in ("before", "after", "gain")]
    return top.join(where, "pair").join(partners, "column").select("column", "target", "sheet", "from_column", "to_column", "covers", *rounded)


def suggest_attributes(new: DataFrame, master: DataFrame, new_roles: dict[str, str] | None = None, master_roles: dict[str, str] | None = None, threshold: float = 0.7) -> list[dict]:
    """Pairs of dimension columns with 2 to 500 labels: for each of master the best
    column of new that is still free, by name and shared labels."""
    roles = column_roles(new, new_roles), column_roles(master, master_roles)

    def fit(df: DataFrame, role: dict[str, str]) -> list[str]:
        names = [c for c in df.columns if role.get(c) == "dimension"]
        return [c for c, n in distinct_counts(df, names).items() if 1 < n <= 500]

    left, right = fit(master, roles[1]), fit(new, roles[0])
    if not left or not right:
        return []
    pick = lambda df, names: df.select(*[F.col(f"`{c}`") for c in names])
    shared = {(r["left"], r["right"]): r["overlap"] for r in overlaps(pick(master, left), pick(new, right)).collect()}
    table = {(m, n): max(score_names(m, n), 0.5 * score_names(m, n) + 0.7 * shared.get((m, n), 0.0)) for m in left for n in right}
    out: list[dict] = []
    while left and right:
        # The first column of master that is left takes the best that is free.
        m = left.pop(0)
        score, _, n = max((table[m, n], -i, n) for i, n in enumerate(right))
        if score >= threshold:
            out.append({"new": n, "master": m})
            right.remove(n)
    return out


# Fixed value: names of an id column.
ID_NAME = re.compile(r"^id$|\bvisit\s*id\b|\btransaction\s*id\b", re.I)


def guess_id(df: DataFrame) -> str | None:
    """A visit, transaction or plain id by name, else a numeric column with id in it."""
    named = (c for c in df.columns if ID_NAME.search(c))
    numeric = (c for c, k in kinds(df).items() if k == "number" and re.search("id", c, re.I) and not c.startswith("__"))
    return next(named, next(numeric, None))


# Prices of an output and the standard price that they should be near.
PRICE_PAIRS = [("NTP", "NTP REGULAR"), ("UNIT TP", "UTP"), ("UNIT SP", "USP"), ("CONSUMER PRICE", "USP")]


def suggest_validations(columns: dict[str, str], master_columns: list[str] = ()) -> list[dict]:
    quantity = re.compile(r"qty|quantity|discount|amount|sales?|net|price|value", re.I)
    own = [{"column": c, "type": "non_negative", "enabled": True, "blocking": False} for c, k in columns.items() if k == "number" and quantity.search(c)]
    near = [{"column": c, "type": "range_pct", "reference": f"master.{m}", "pct": 10, "enabled": True} for c, m in PRICE_PAIRS if c in columns and m in master_columns]
    return own + near


def column_roles(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """date, measure or dimension by type (text that is mostly numbers is a measure)."""
    by, overrides = kinds(df), overrides or {}
    texts = [c for c, k in by.items() if k == "text" and not c.startswith("__")]
    share = df.agg(*[F.coalesce(F.avg(F.when(F.col(f"`{c}`").isNotNull(), num(F.col(f"`{c}`")).isNotNull().cast("int"))), F.lit(1.0)).alias(f"s{i}") for i, c in enumerate(texts)]).first() if texts else []
    numeric = {c for i, c in enumerate(texts) if share[i] > 0.8}
    role = {"date": "date", "bool": "dimension", "number": "measure", "null": "measure"}
    return {c: overrides.get(c) or role.get(k) or ("measure" if c in numeric else "dimension") for c, k in by.items() if not c.startswith("__")}


#: Values that a profile shows of each column, and rows of a head.
SAMPLES, HEAD = 3, 25


def profile(df: DataFrame, row_id: str = "__row_id") -> DataFrame:
    """(column, type, non_null, nulls, distinct_values, samples), by one pass that counts each
    column's values, combined in the tasks. samples are the first values that are not
    null, in the order of row_id (of the values themselves without it), as texts."""
    by = kinds(df)
    names = [c for c in df.columns if not c.startswith("__")]
    at = F.col(row_id).cast("bigint") if row_id in df.columns else F.lit(0).cast("bigint")
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"))
    cells = df.select(at.alias("at"), F.explode(F.array(*[cell(c) for c in names])).alias("c")).select("at", "c.*")
    counted = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values"))
    # Each task keeps its first rows of a column before any are sent.
    first = Window.partitionBy("column").orderBy("at", "v")
    top = cells.filter("v is not null").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLES)
    samples = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("samples"))
    kind = F.element_at(F.create_map(*[F.lit(x) for c in names for x in (c, by[c])]), F.col("column"))
    return sizes.join(samples, "column", "left").select("column", kind.alias("type"), "non_null", "nulls", "distinct_values", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def head(df: DataFrame, rows: int = HEAD, row_id: str = "__row_id") -> DataFrame:
    """The first rows, without the engine's own columns."""
    return df.orderBy(row_id).limit(rows).select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])

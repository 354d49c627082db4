"""One batch: read the three tables, fill the grid, gate it, write the sheets, load the
clean rows and report. The plan runs once: its rows are written and read from there."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import quality
from ..sources import sinks, tables
from .pipeline import Inputs, Result, build_output

ROLES = ("new", "master", "historical")


def load(result: Result, path: str, key_columns: list[str] | None = None, on_unevaluable: str = "fail", dry_run: bool = False, sheets: str | None = None, partition: str | None = None) -> dict:
    """Gate a result, write its quarantine and other sheets (below the folder sheets) and
    upsert its clean rows. A blocking rule that cannot be evaluated stops the load before
    anything is written."""
    try:
        # Before anything is written: the rules are known from the plan alone.
        blocked = [why for rule, why in result.unevaluable if rule.get("blocking")]
        if blocked and on_unevaluable == "fail":
            raise ValueError(f"blocking rules cannot be evaluated: {blocked}")
        result = result.saved()
        clean, quarantine = result.gate()
        counts = result.counts().first()
        out = {"rows": counts["rows"], "filled": counts["filled"], "quarantined": quarantine.count(), "excluded": result.excluded.count(), "dropped_variants": result.variants.first()[0]}
        out["clean"] = out["rows"] - out["quarantined"]
        if sheets:
            frames = {"Output Data": result.output, "Quarantined Rows": quarantine, "Validation Issues": result.issues(), "Excluded New Rows": result.excluded}
            if result.additions is not None:
                frames["Master Additions"] = result.additions
            shown = {k: v for k, v in frames.items() if k == "Output Data" or not v.isEmpty()}
            out["sheets"] = sinks.write_sheets(shown | {"Run Summary": sinks.summary(result.output.sparkSession, out)}, sheets)
        if dry_run or not out["clean"]:
            return out | {"loaded": False}
        keys = sinks.resolve_keys(clean.columns, key_columns)
        done = sinks.upsert_partitions(clean, path, keys, partition) if partition else sinks.upsert(clean, path, key_columns)
        return out | done | {"loaded": True}
    finally:
        result.close()


def read_inputs(spark: SparkSession, batch: dict, folder: str, new_file: str | None = None) -> Inputs:
    files = tables.resolve_files(spark, folder, batch.get("files"), new_file)
    frames: dict[str, DataFrame] = {}
    for role in ROLES:
        own = (batch.get("sheets") or {}).get(role) or {}
        sheet = tables.choose_sheet(spark, files[role], role, own.get("sheet"))
        frames[role] = tables.read_table(spark, files[role], None if sheet == "(csv)" else sheet, own.get("header_row"))
    return Inputs(**frames)


def run(spark: SparkSession, profile: dict, batch: dict, folder: str, path: str, new_file: str | None = None, dry_run: bool = False, notify: Callable[[str, dict], None] | None = None) -> dict:
    """profile: the plan's configuration; batch: files, sheets, qc (blocking, warn_only,
    extra_validations, on_unevaluable), database (key_columns, partition), output_dir.
    The status is written as JSON whatever happens; notify gets a subject and the status
    if rows need attention or the run fails."""
    out_dir, started = batch.get("output_dir") or f"{folder}/output", datetime.datetime.now()
    status = {"status": "running", "started": started.isoformat(), "new_file": new_file}
    try:
        config = profile | {"value_maps": [m for m in profile.get("value_maps") or [] if m.get("enabled")], "validations": quality.assemble_rules(profile, batch)}
        result = build_output(read_inputs(spark, batch, folder, new_file), config)
        db = batch.get("database") or {}
        got = load(result, path, db.get("key_columns"), str((batch.get("qc") or {}).get("on_unevaluable", "fail")).lower(), dry_run, f"{out_dir}/run_{started:%Y%m%d_%H%M%S_%f}", db.get("partition"))
        attention = bool(got["quarantined"] or got["excluded"])
        status |= got | {"status": "completed_with_attention" if attention else "completed", "warnings": result.warnings}
        if attention and notify:
            notify("rows need attention", status)
        return status
    except Exception as e:
        status |= {"status": "failed", "error": str(e)}
        if notify:
            notify("the run failed", status)
        raise
    finally:
        status["finished"] = datetime.datetime.now().isoformat()
        sinks.write_status(spark, f"{out_dir}/last_run.json", status)


def read_status(spark: SparkSession, path: str) -> dict | None:
    fs, p = sinks._fs(spark, path)
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect())) if fs.exists(p) else None

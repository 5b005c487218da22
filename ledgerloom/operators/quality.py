"""Typed quality checks over a dataset: one pass gives every check's failing rows and counts.

Each row-level check is a boolean column. Mean, deviation and quartiles are computed first,
for all checks of a dataset that need them, and enter the pass as plain numbers. A run stores
the failing rows of routed checks while it counts; results, exceptions and events come from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DQConfig
from ..functions.bands import whole_days
from ..functions.scan import exact_quantiles, with_rank, with_sequence
from ..functions.scratch import materialize

# fixed values: the rule a check type stands for when none is named
_IMPLIED = {"timeliness": "staleness", "anomaly": "zscore"}
# fixed values: rules by check type; None takes any rule name
_RULES = {
    "completeness": {"null", "count"},
    "accuracy": {"range", "enum", "referential"},
    "consistency": None,
    "timeliness": {"staleness"},
    "anomaly": {"zscore", "iqr"},
}

TableReader = Callable[[str], DataFrame]


@dataclass
class Check:
    """One configured check of a dataset, ready to run."""

    dataset: str
    seq: int
    type: str
    rule: str
    name: str
    severity: str
    routed: bool
    params: dict[str, Any]
    failing: Column | None = None
    all_rows_unless: int | None = None
    warning: str | None = None
    missing_keys: DataFrame | None = None
    fields: list[str] = field(default_factory=list)

    @property
    def flag(self) -> str:
        return f"_fails_{self.seq}"


def plan_check(dataset: str, seq: int, cfg: dict[str, Any], first_named: dict[str, Any]) -> Check:
    kind, rule = cfg["type"], cfg.get("rule")
    if not rule:
        rule = ("count" if "expected_count" in cfg else "null") if kind == "completeness" else _IMPLIED.get(kind)
    allowed = _RULES.get(kind, set())
    if allowed is not None and rule not in allowed:
        raise ValueError(f"unknown check {kind}/{rule} in dataset '{dataset}'")
    default_name = "referential" if rule == "referential" else f"{kind}/{rule}"
    name = cfg.get("name", default_name)
    # the first check of that name in the dataset decides where its failures go
    routed = bool(first_named.get(name, {}).get("route_failures", kind != "anomaly"))
    return Check(dataset, seq, kind, rule, name, cfg.get("severity", "low"), routed, cfg)


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name).try_cast("double") if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")


def _no_number(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def is_blank(value: Column, kind: str = "string") -> Column:
    """Null, not a number, or nothing but white space; ``kind`` is the column's type."""
    blank = value.isNull() | (F.regexp_replace(value.cast("string"), r"(?U)\s", "") == "")
    return blank | F.isnan(value) if kind in ("double", "float") else blank


def _key_text(df: DataFrame, name: str) -> Column:
    """A column as text, null where it is not a number."""
    value = F.col(name)
    return (F.when(~F.isnan(value), value) if dict(df.dtypes)[name] in ("double", "float") else value).cast("string")


def range_fails(value: Column, minimum: float | None, maximum: float | None) -> Column:
    bad = _no_number(value)
    if minimum is not None:
        bad = bad | (value < F.lit(float(minimum)))
    if maximum is not None:
        bad = bad | (value > F.lit(float(maximum)))
    return bad


def instant_of(value: Column) -> Column:
    """A date, timestamp or text as zone-free UTC, null where it is none."""
    # text with a zone is an instant: it is moved to UTC, where a plain cast would drop the offset
    zoned = value.cast("string").rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$")
    shifted = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(zoned, shifted).otherwise(value.try_cast("timestamp_ntz"))


def older(instant: Column, as_of: datetime, max_age_days: int) -> Column:
    now = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.coalesce(whole_days(now, instant) > F.lit(int(max_age_days)), F.lit(False))


def stale_fails(value: Column, as_of: datetime, max_age_days: int) -> Column:
    return older(instant_of(value), as_of, max_age_days)


def _usable(df: DataFrame, name: str) -> Column:
    value = _number(df, name)
    return F.when(~_no_number(value), value)


def moments(df: DataFrame, names: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and deviation of several columns, in one aggregate."""
    if not names:
        return {}
    row = df.agg(*[f(_usable(df, n)) for n in names for f in (F.avg, F.stddev_pop)]).first()
    return {n: (row[2 * i], row[2 * i + 1]) for i, n in enumerate(names)}


def zscore_fails(
    df: DataFrame, name: str, threshold: float, known: dict[str, tuple[float | None, float | None]] | None = None
) -> Column:
    usable = _usable(df, name)
    mean, spread = (known or moments(df, [name]))[name]
    if spread is None or spread == 0 or not math.isfinite(spread):
        return F.lit(False)
    return F.coalesce(F.abs(usable - F.lit(mean)) / F.lit(spread) > F.lit(float(threshold)), F.lit(False))


def iqr_fails(df: DataFrame, name: str, threshold: float) -> Column:
    value = _number(df, name)
    count, quartiles = exact_quantiles(df.select(value.alias("v")), "v", [0.25, 0.75])
    if count < 4 or quartiles[0] == quartiles[1]:
        return F.lit(False)
    low, high = quartiles
    reach = float(threshold) * (high - low)
    usable = F.when(~_no_number(value), value)
    return F.coalesce((usable < F.lit(low - reach)) | (usable > F.lit(high + reach)), F.lit(False))


def missing_parents(child: DataFrame, name: str, parent: DataFrame | None, parent_name: str) -> DataFrame:
    """Distinct child keys without a parent. Keys are reduced before they are shuffled, so hot keys cost nothing."""
    keys = child.select(_key_text(child, name).alias("key")).where("key IS NOT NULL").distinct()
    if parent is None:
        return keys
    known = parent.select(_key_text(parent, parent_name).alias("key")).where("key IS NOT NULL").distinct()
    return keys.join(known, "key", "left_anti")


def _prepare(
    check: Check, df: DataFrame, cfg: DQConfig, read: TableReader, as_of: datetime, known: dict[str, tuple[float | None, float | None]]
) -> None:
    p, rule = check.params, check.rule
    name = p.get("field")
    if rule == "count":
        check.all_rows_unless = int(p["expected_count"])
        return
    if check.type == "consistency":
        check.fields = ["available_balance", "current_balance"] if rule == "available_le_current" else []
        if rule != "available_le_current":
            check.failing, check.warning = F.lit(False), f"unknown rule {rule}"
            return
    else:
        check.fields = [name]
    absent = [f for f in check.fields if f not in df.columns]
    if absent:
        check.failing, check.warning = F.lit(False), f"no column {', '.join(absent)}"
        return
    if check.type == "consistency":
        scope = F.coalesce(F.col("account_type") != "loan", F.lit(True)) if "account_type" in df.columns else F.lit(True)
        available, current = _number(df, "available_balance"), _number(df, "current_balance")
        over = available.isNotNull() & current.isNotNull() & ~F.isnan(available) & ~F.isnan(current) & (available > current)
        check.failing = scope & F.coalesce(over, F.lit(False))
    elif rule == "null":
        check.failing = is_blank(F.col(name), dict(df.dtypes)[name])
    elif rule == "range":
        check.failing = range_fails(_number(df, name), p.get("min", p.get("minimum")), p.get("maximum"))
    elif rule == "enum":
        value = _key_text(df, name)
        check.failing = value.isNotNull() & ~value.isin([str(v) for v in p["values"]])
    elif rule == "staleness":
        check.failing = stale_fails(F.col(name), as_of, p["max_age_days"])
    elif rule == "zscore":
        check.failing = zscore_fails(df, name, p.get("threshold", 3.0), known)
    elif rule == "iqr":
        check.failing = iqr_fails(df, name, p.get("threshold", 1.5))
    elif rule == "referential":
        parent = None
        if p.get("reference_dataset"):
            other = cfg.datasets.get(p["reference_dataset"], {}).get("table", p["reference_dataset"])
            parent = read(other)
        lost = missing_parents(df, name, parent, p.get("reference_field", "account_id"))
        # stored, so that the planner knows their size and need not shuffle the dataset when they are few
        check.missing_keys = materialize(lost, "missing")


@dataclass
class DatasetRun:
    dataset: str
    id_field: str | None
    order: list[str]
    checks: list[Check]
    flagged: DataFrame


def flag_dataset(dataset: str, cfg: DQConfig, read: TableReader, as_of: datetime) -> DatasetRun:
    """The dataset's rows with one boolean column per check."""
    spec = cfg.datasets[dataset]
    df = read(spec.get("table", dataset))
    named: dict[str, Any] = {}
    for raw in spec.get("checks", []):
        named.setdefault(raw.get("name"), raw)
    checks = [plan_check(dataset, i, raw, named) for i, raw in enumerate(spec.get("checks", []), start=1)]
    measured = {c.params["field"] for c in checks if c.rule == "zscore" and c.params.get("field") in df.columns}
    known = moments(df, sorted(measured))
    for check in checks:
        _prepare(check, df, cfg, read, as_of, known)
    id_field = spec.get("id_field")
    has_id = id_field in df.columns
    order = [spec.get("order_field", id_field)] if has_id else []
    flagged = df
    for check in checks:
        if check.missing_keys is not None:
            lost = check.missing_keys.withColumnRenamed("key", f"_lost_{check.seq}")
            flagged = flagged.join(lost, _key_text(df, check.fields[0]) == lost[f"_lost_{check.seq}"], "left")
            check.failing = F.col(f"_lost_{check.seq}").isNotNull()
    ids = [F.col(id_field).cast("string").alias("_id"), *[F.col(o).alias("_order") for o in order]] if has_id else []
    flags = [c.failing.alias(c.flag) for c in checks if c.failing is not None]
    return DatasetRun(dataset, id_field if has_id else None, order, checks, flagged.select(*ids, *flags))


def _counts(run: DatasetRun) -> list[Column]:
    flags = [F.count_if(F.col(c.flag)).alias(c.flag) for c in run.checks if c.failing is not None]
    return [F.count(F.lit(1)).alias("checked"), *flags]


def check_results(run: DatasetRun, as_of: datetime) -> DataFrame:
    """Rows of ``dq_results`` for one dataset, from a single aggregate over its flagged rows."""
    return _result_rows(run, run.flagged.agg(*_counts(run)), as_of)


def _result_rows(run: DatasetRun, counted: DataFrame, as_of: datetime) -> DataFrame:
    rows = []
    for c in run.checks:
        failing = F.col(c.flag) if c.failing is not None else (
            F.when(F.col("checked") == c.all_rows_unless, 0).otherwise(F.col("checked"))
        )
        rows.append(F.struct(
            F.lit(f"DQ-{run.dataset}-{c.seq:04d}").alias("dq_check_id"), F.lit(run.dataset).alias("dataset_name"),
            F.lit(c.type).alias("check_type"), F.lit(c.name).alias("check_name"),
            failing.cast("bigint").alias("failing"), F.lit(c.warning).cast("string").alias("warning"),
            F.lit(c.seq).alias("seq"), F.lit(bool(c.routed and c.failing is not None and run.id_field)).alias("routed"),
        ))
    listed = counted.select("checked", F.explode(F.array(*rows)).alias("c")).select("checked", "c.*")
    stamp = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return listed.select(
        "dq_check_id", "dataset_name", "check_type", "check_name", (F.col("failing") == 0).alias("passed"),
        F.col("failing").cast("int").alias("failing_records"),
        check_score(F.col("checked"), F.col("failing")).alias("quality_score"), stamp.alias("checked_at"),
        "checked", "warning", "seq", "routed",
    )


def check_score(checked: Column, failing: Column) -> Column:
    kept = checked - F.greatest(F.lit(0), F.least(failing, checked))
    return F.when(checked <= 0, F.lit(100.0)).otherwise(F.round(F.lit(100.0) * kept / checked, 4))


def failing_rows(run: DatasetRun) -> DataFrame:
    """Every failing id of every routed check: (seq, check_name, severity, _order, _id)."""
    return _hits(run, run.flagged)


def _hits(run: DatasetRun, flagged: DataFrame) -> DataFrame:
    entries = [
        F.when(F.col(c.flag), F.struct(F.lit(c.seq).alias("seq"), F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity")))
        for c in run.checks if c.routed and c.failing is not None
    ]
    return flagged.select(
        "_id", F.col("_order").cast("string").alias("_order"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("c")
    ).select("c.seq", "c.check_name", "c.severity", "_order", "_id")


@dataclass
class QualityRun:
    results: DataFrame
    exceptions: DataFrame
    events: DataFrame


def quality_results(cfg: DQConfig, read: TableReader, as_of: datetime, dataset: str | None = None) -> DataFrame:
    """Result rows alone: one aggregate per dataset, nothing routed or stored."""
    parts = [check_results(flag_dataset(name, cfg, read, as_of), as_of) for name in _chosen(cfg, dataset)]
    return reduce(DataFrame.unionByName, parts).drop("seq", "routed")


def _chosen(cfg: DQConfig, dataset: str | None) -> list[str]:
    if dataset is not None and dataset not in cfg.datasets:
        raise ValueError(f"no checks are configured for dataset '{dataset}'")
    names = [dataset] if dataset is not None else list(cfg.datasets)
    if not names:
        raise ValueError("no datasets are configured")
    return names


def run_quality(
    cfg: DQConfig, read: TableReader, as_of: datetime, batch_id: str, dataset: str | None = None
) -> QualityRun:
    """All configured checks: result rows, routed exceptions and unchained audit events.

    A dataset is read once: its failing rows are written while its counts are observed (a number per check
    reaches the driver). Every failing row is routed. ``max_exceptions_per_check`` is for callers who want a
    shorter queue: the first rows of each check stay, and ``withheld`` of the results counts the others.
    """
    results, failing, cap = [], [], cfg.max_exceptions_per_check
    for place, name in enumerate(_chosen(cfg, dataset)):
        run = flag_dataset(name, cfg, read, as_of)
        if run.id_field and any(c.routed and c.failing is not None for c in run.checks):
            seen = Observation()
            hits = materialize(_hits(run, run.flagged.observe(seen, *_counts(run))), "failing")
            counted = hits.sparkSession.createDataFrame([seen.get])
            failing.append(hits.select(F.lit(place).alias("set_place"), F.lit(name).alias("dataset_name"), *hits.columns))
        else:
            counted = run.flagged.agg(*_counts(run))
        results.append(_result_rows(run, counted, as_of).withColumn("place", F.lit(place)))
    rows = reduce(DataFrame.unionByName, results)
    withheld = F.greatest(F.col("failing_records") - F.lit(cap), F.lit(0)) if cap is not None else F.lit(0)
    rows = rows.withColumn("withheld", F.when(F.col("routed"), withheld).otherwise(0).cast("bigint")).drop("routed", "seq")
    spark = rows.sparkSession
    hits = reduce(DataFrame.unionByName, failing) if failing else spark.createDataFrame([], _HITS)
    if cap is not None:
        hits = with_rank(hits, ["set_place", "seq"], ["_order", "_id"], "_place").where(F.col("_place") <= cap).drop("_place")
    exceptions = _exceptions(hits, batch_id, as_of)
    return QualityRun(rows.drop("place"), exceptions.drop("check_name", "exc_seq"), _events(exceptions, rows, batch_id))


_HITS = "set_place int, dataset_name string, seq int, check_name string, severity string, _order string, _id string"


def _exceptions(failing: DataFrame, batch_id: str, as_of: datetime) -> DataFrame:
    stamp = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    nothing = F.lit(None)
    severity = F.when(F.col("severity").isin("high", "medium", "low"), F.col("severity")).otherwise("low")
    numbered = with_sequence(failing, ["set_place", "seq", "_order", "_id"], "exc_seq")
    return numbered.select(
        F.format_string(f"EXC-{batch_id.replace('%', '%%')}-%06d", "exc_seq").alias("exception_id"), F.lit("dq").alias("source"),
        F.concat("dataset_name", F.lit(":"), "_id").alias("reference_id"), severity.alias("priority"),
        nothing.cast("string").alias("assigned_to"), F.lit("open").alias("status"), stamp.alias("created_at"),
        nothing.cast("timestamp_ntz").alias("resolved_at"), nothing.cast("string").alias("resolution_notes"),
        nothing.cast("string").alias("root_cause"), "check_name", "exc_seq",
    )


def _events(exceptions: DataFrame, results: DataFrame, batch_id: str) -> DataFrame:
    opened = exceptions.select(
        F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("exc_seq").cast("string").alias("c")).alias("ord"),
        F.col("exc_seq").alias("n"), F.lit("exception_open").alias("event_type"), F.lit("exception").alias("entity_type"),
        F.col("exception_id").alias("entity_id"), F.concat(F.lit("exception_open:"), "check_name").alias("action"),
    )
    ran = results.select(
        F.struct(F.lit(1).alias("a"), F.col("place").alias("b"), F.col("dq_check_id").alias("c")).alias("ord"),
        F.lit(0).alias("n"), F.lit("dq_check").alias("event_type"), F.lit("dq_check").alias("entity_type"),
        F.col("dq_check_id").alias("entity_id"), F.col("check_name").alias("action"),
    )
    both = opened.unionByName(ran)
    return both.select(
        F.struct("ord.a", "ord.b", "n", "ord.c").alias("ord"), "event_type", "entity_type", "entity_id", "action",
        F.lit(batch_id).alias("batch_id"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("checks_run"),
        F.count_if("passed").alias("checks_passed"),
        F.count_if(~F.col("passed")).alias("checks_failed"),
        F.coalesce(F.sum("failing_records"), F.lit(0)).alias("total_failing_records"),
    )


def type_weight(weights: dict[str, float]) -> Column:
    """Weight of a check type; types the settings leave out weigh 1."""
    known = F.lit(1.0)
    for name, weight in weights.items():
        known = F.when(F.col("check_type") == name, F.lit(float(weight))).otherwise(known)
    return known


def dataset_scores(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per dataset: weighted score over the check types, anomaly rate, and number of checks."""
    by_type = results.groupBy("dataset_name", "check_type").agg(
        F.avg("quality_score").alias("type_score"), F.count(F.lit(1)).alias("checks")
    ).withColumn("weight", type_weight(weights))
    anomaly = F.max(F.when(F.col("check_type") == "anomaly", F.col("type_score")))
    score = F.when(F.sum("weight") > 0, F.round(F.sum(F.col("type_score") * F.col("weight")) / F.sum("weight"), 4))
    return by_type.groupBy("dataset_name").agg(
        F.coalesce(score, F.lit(100.0)).alias("quality_score"),
        F.round(F.lit(100.0) - anomaly, 4).alias("anomaly_rate"), F.sum("checks").alias("checks"),
    )


def check_view(results: DataFrame) -> DataFrame:
    return results.select(
        "dataset_name", "check_name", "check_type", "passed", "failing_records", "quality_score"
    ).orderBy("dataset_name", "check_name")

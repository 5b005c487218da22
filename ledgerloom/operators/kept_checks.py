"""Quality results kept up file by file: a rerun reads the files that are new and no others.

What a check needs to know of a file is stored once, as counts that add up:

- rows, and failing rows of the checks that look at a row alone;
- count, mean and squared deviations of fields with a z-score, merged over files;
- for fields compared with limits that move (z-score, quartiles, age at a date), how often each value occurs, sorted, and
  for each bin of values their number, least and greatest. A bin that lies on one side of a limit is counted whole; of
  the one or two bins that a limit cuts, the values are read. Quartiles are selected inside the bin of their rank;
- keys without a parent, and the parents' keys. Old lost keys and new files' keys are compared with the parents' stored keys.

The state is a table store with a commit per refresh, so a stopped refresh has changed nothing. Files are known by path and never
change in place, as Spark writes them. A file that is gone drops out of all counts; where a parents' file is gone
the state is begun anew. Other checks, or other columns, are another state.

Defined results: as ``quality.quality_results`` over the same rows; the mean is merged from files and may differ from it in the last digit.
A table without files has no rows. Repeated rows count each time.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DQConfig
from ..functions.scan import interpolated, ranked, wanted_ranks
from ..sources.tables import TableStore
from . import quality as Q

_PATH, _STEPS = "_kept_path", 16
_ORDERED = {"zscore": "numbers", "iqr": "numbers", "staleness": "instants"}


def number_bin(value: Column) -> Column:
    """A bin by sign and magnitude, 16 to a doubling; it never decreases with the value."""
    size = F.when(F.abs(value) == float("inf"), F.lit(40000.0)).otherwise(F.floor(F.log2(F.abs(value)) * _STEPS) + 20000)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("int")


def day_bin(instant: Column) -> Column:
    return F.datediff(instant.cast("date"), F.lit("1970-01-01").cast("date"))


class KeptChecks:
    """The stored state of one dataset's checks in ``folder``; ``read`` gives a table as a DataFrame over Parquet files."""

    def __init__(self, spark: SparkSession, folder: str, cfg: DQConfig, dataset: str, read: Q.TableReader) -> None:
        self.spark, self.cfg, self.dataset, self.read = spark, cfg, dataset, read
        spec = cfg.datasets[dataset]
        self.rows = read(spec.get("table", dataset))
        named: dict = {}
        for raw in spec.get("checks", []):
            named.setdefault(raw.get("name"), raw)
        self.checks = [Q.plan_check(dataset, i, raw, named) for i, raw in enumerate(spec.get("checks", []), start=1)]
        self.moving = {c.seq: c for c in self.checks if self._moves(c)}
        for check in self.checks:
            if check.seq not in self.moving:
                # row checks depend on no date and no other row
                Q._prepare(check, self.rows, cfg, read, datetime(1970, 1, 1), {})
        self.id_field = spec.get("id_field") if spec.get("id_field") in self.rows.columns else None
        mark = hashlib.md5((json.dumps(spec, sort_keys=True, default=str) + self.rows.schema.simpleString()).encode()).hexdigest()[:12]
        self.store = TableStore(spark, f"{folder.rstrip('/')}/{dataset}-{mark}")

    def _moves(self, check: Q.Check) -> bool:
        return check.type != "consistency" and check.rule in (*_ORDERED, "referential") and check.params["field"] in self.rows.columns

    def _fields(self, *rules: str) -> list[str]:
        return sorted({c.params["field"] for c in self.moving.values() if c.rule in rules})

    def _parent(self, check: Q.Check) -> tuple[DataFrame, str] | None:
        other = check.params.get("reference_dataset")
        if not other:
            return None
        return self.read(self.cfg.datasets.get(other, {}).get("table", other)), check.params.get("reference_field", "account_id")

    # refresh

    def _seen(self, table: str, keep: str = "true") -> set[str]:
        """Paths noted before; Spark's driver lists as many for any read."""
        return {r[0] for r in self.store.read(table).where(keep).select("path").collect()} if self.store.exists(table) else set()

    def refresh(self) -> list[str]:
        """Take in the files that are new; returns their paths."""
        listed, parents = _files(self.rows), {}
        for check in self.moving.values():
            if check.rule == "referential" and (parent := self._parent(check)) is not None:
                now = _files(parent[0])
                parents[check.seq] = (*parent, now, self._seen("parent_files", f"seq = {check.seq}"))
        anew = any(seen - now for _, _, now, seen in parents.values())
        new = sorted(listed - (set() if anew else self._seen("files")))
        if not new and not any(now - seen for _, _, now, seen in parents.values()) and self.store.exists("files"):
            return []
        mode = "replace" if anew else "append"
        with self.store.job():
            paths = self.spark.createDataFrame([(p,) for p in new], "path string")
            self.store.write("files", paths.withColumn("file", F.xxhash64("path")), mode)
            self._parents(parents, anew, mode)
            rows = _only(self.rows, new, listed).withColumn("file", F.xxhash64(_PATH))
            self.store.write("counts", self._counts(rows), mode)
            for table, rules in (("numbers", ("zscore", "iqr")), ("instants", ("staleness",))):
                if self._fields(*rules):
                    self._values(table, rows, self._fields(*rules), mode)
            self._lost(rows, mode)
        noted = self.store.read("files").agg(F.count_distinct("path") - F.count_distinct("file")).first()[0]
        if noted:
            raise ValueError("two files have one hash")
        return new

    def _parents(self, parents: dict[int, tuple], anew: bool, mode: str) -> None:
        keys, paths = [], []
        for seq, (df, name, now, seen) in parents.items():
            fresh = sorted(now if anew else now - seen)
            paths += [(seq, p) for p in fresh]
            own = _only(df, fresh, now).select(F.lit(seq).alias("seq"), Q._key_text(df, name).alias("key"))
            keys.append(own.where("key IS NOT NULL").distinct())
        if parents:
            self.store.write("parent_files", self.spark.createDataFrame(paths, "seq int, path string"), mode)
            self.store.write("parent_keys", reduce(DataFrame.unionByName, keys), mode)

    def _counts(self, rows: DataFrame) -> DataFrame:
        flags = [F.count_if(c.failing).alias(c.flag) for c in self.checks if c.failing is not None]
        spread = []
        for i, name in enumerate(self._fields("zscore")):
            value = Q._usable(self.rows, name)
            spread += [
                F.count(value).alias(f"n_{i}"), F.avg(value).alias(f"mean_{i}"), (F.var_pop(value) * F.count(value)).alias(f"squares_{i}")
            ]
        return rows.groupBy("file").agg(F.count(F.lit(1)).alias("checked"), *flags, *spread)

    def _values(self, table: str, rows: DataFrame, fields: list[str], mode: str) -> None:
        of, into = (lambda n: Q._usable(self.rows, n), number_bin) if table == "numbers" else (lambda n: Q.instant_of(F.col(n)), day_bin)
        entries = F.array(*[F.struct(F.lit(n).alias("field"), of(n).alias("v")) for n in fields])
        each = rows.select("file", F.explode(entries).alias("e")).select("file", "e.*").where("v IS NOT NULL")
        counted = each.groupBy("file", "field", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", into(F.col("v")))
        # sorted, so that the few bins that a limit cuts are few row groups
        order = ["field", "bin", "v"]
        self.store.write(table, counted.repartitionByRange(*order).sortWithinPartitions(*order), mode)
        bins = self.store.read(table, last=True).groupBy("file", "field", "bin")
        self.store.write(f"{table}_bins", bins.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), mode)

    def _lost(self, rows: DataFrame, mode: str) -> None:
        found = []
        for check in self.moving.values():
            if check.rule == "referential":
                keyed = rows.select("file", F.lit(check.seq).alias("seq"), Q._key_text(self.rows, check.params["field"]).alias("key"))
                found.append(keyed.where("key IS NOT NULL").groupBy("file", "seq", "key").agg(F.count(F.lit(1)).alias("n")))
        if found:
            self.store.write("lost_keys", self._without_parent(reduce(DataFrame.unionByName, found)), mode)

    def _without_parent(self, keyed: DataFrame) -> DataFrame:
        return keyed.join(self.store.read("parent_keys"), ["seq", "key"], "left_anti") if self.store.exists("parent_keys") else keyed

    # results

    def _live(self, table: str) -> DataFrame:
        found = self.store.read(table)
        gone = sorted(self._seen("files") - _files(self.rows))
        if not gone:
            return found
        return found.join(self.spark.createDataFrame([(p,) for p in gone], "path string").select(F.xxhash64("path").alias("file")), "file", "left_anti")

    def _beyond(self, table: str, name: str, side: Callable[[Column], Column]) -> int:
        """Rows with a value on a wrong side; ``side`` is 0 inside and never decreases, or never increases, with the value."""
        bins = self._live(f"{table}_bins").where(F.col("field") == name).select("bin", "n", side(F.col("low")).alias("a"), side(F.col("high")).alias("b"))
        cut = [r[0] for r in bins.where("a <> b").select("bin").distinct().collect()]
        whole = bins.where((F.col("a") != 0) & ~F.col("bin").isin(cut)).agg(F.sum("n")).first()[0] or 0
        if not cut:
            return whole
        inside = self._live(table).where((F.col("field") == name) & F.col("bin").isin(cut))
        return whole + (inside.where(side(F.col("v")) != 0).agg(F.sum("n")).first()[0] or 0)

    def _quartiles(self, name: str) -> tuple[int, list[float]]:
        bins = self._live("numbers_bins").where(F.col("field") == name).groupBy("bin").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        # a row per bin: 16 to a doubling, whatever the number of values
        rows = sorted(bins.collect(), key=lambda r: r["bin"])
        total, before, open_, cut, found = sum(r["n"] for r in rows), 0, [], [], {}
        if total < 4:
            return total, []
        wanted = wanted_ranks(total, [0.25, 0.75])
        for r in rows:
            own = [k for k in wanted if before <= k < before + r["n"]]
            if own and r["low"] == r["high"]:
                found.update({k: r["low"] for k in own})
            elif own:
                open_.append((r["low"], r["high"], before, r["n"], own))
                cut.append(r["bin"])
            before += r["n"]
        if open_:
            inside = self._live("numbers").where((F.col("field") == name) & F.col("bin").isin(cut)).select("v", "n")
            found |= ranked(inside, open_)
        return total, interpolated(total, [0.25, 0.75], found)

    def _moments(self, place: int) -> tuple[float | None, float | None]:
        """Mean and deviation from those of the files."""
        n, mean, squares = (F.col(f"{k}_{place}") for k in ("n", "mean", "squares"))
        counts = self._live("counts").where(n > 0)
        total, middle = counts.agg(F.sum(n), F.sum(mean * n) / F.sum(n)).first() if not counts.isEmpty() else (0, None)
        if not total or middle is None or not math.isfinite(middle):
            return middle, None
        return middle, math.sqrt(counts.agg(F.sum(squares + n * (mean - middle) * (mean - middle))).first()[0] / total)

    def _failing(self, check: Q.Check, as_of: datetime) -> int:
        name = check.params["field"]
        if check.rule == "referential":
            return self._without_parent(self._live("lost_keys").where(F.col("seq") == check.seq)).agg(F.sum("n")).first()[0] or 0
        if check.rule == "staleness":
            return self._beyond("instants", name, lambda v: Q.older(v, as_of, check.params["max_age_days"]).cast("int"))
        if check.rule == "zscore":
            mean, spread = self._moments(self._fields("zscore").index(name))
            if not spread or not math.isfinite(spread):
                return 0
            far, limit = lambda v: (v - F.lit(mean)) / F.lit(spread), float(check.params.get("threshold", 3.0))
            return self._beyond("numbers", name, lambda v: F.when(F.abs(far(v)) > limit, F.signum(far(v))).otherwise(0.0))
        total, quartiles = self._quartiles(name)
        if total < 4 or quartiles[0] == quartiles[1]:
            return 0
        low, high = quartiles
        reach = float(check.params.get("threshold", 1.5)) * (high - low)
        return self._beyond("numbers", name, lambda v: F.when(v < low - reach, -1).when(v > high + reach, 1).otherwise(0))

    def results(self, as_of: datetime) -> DataFrame:
        """Rows of ``dq_results``, from the state alone."""
        static = [c for c in self.checks if c.failing is not None]
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("checked", *(c.flag for c in static))]
        counted = self._live("counts").agg(*sums).first().asDict()
        counted |= {c.flag: self._failing(c, as_of) for c in self.moving.values()}
        schema = ", ".join(f"{n} bigint" for n in counted)
        for check in self.moving.values():
            check.failing = F.lit(False)  # counted above; the mark tells that its rows are known
        run = Q.DatasetRun(self.dataset, self.id_field, [], self.checks, self.rows)
        rows = Q._result_rows(run, self.spark.createDataFrame([tuple(counted.values())], schema), as_of).drop("seq", "routed")
        for check in self.moving.values():
            check.failing = None
        return rows


def _files(df: DataFrame) -> set[str]:
    """Paths as rows name them: without the empty host that listings write."""
    # a filter above the files could hide rows that a later read shows
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        raise ValueError("kept checks need a DataFrame that reads files and does nothing else")
    return {p.replace(":///", ":/", 1) for p in df.inputFiles()}


def _only(df: DataFrame, files: list[str], listed: set[str]) -> DataFrame:
    """Rows of these files, with their path; Spark opens no other file."""
    path = F.col("_metadata.file_path")
    chosen = df if files and len(files) == len(listed) else df.where(path.isin(files + [p.replace(":/", ":///", 1) for p in files]))
    return chosen.select("*", F.replace(path, F.lit(":///"), F.lit(":/")).alias(_PATH))


def kept_results(
    spark: SparkSession, folder: str, cfg: DQConfig, read: Q.TableReader, as_of: datetime, dataset: str | None = None
) -> DataFrame:
    """``quality.quality_results`` over tables of files, reading only files that no earlier call has read."""
    parts = []
    for name in Q._chosen(cfg, dataset):
        kept = KeptChecks(spark, folder, cfg, name, read)
        kept.refresh()
        parts.append(kept.results(as_of))
    return reduce(DataFrame.unionByName, parts)

"""Validation cases, compiled: all metrics and comparisons of a case become one aggregate per table and a join with their rules.

A case is a dict (as read from JSON) of ``metrics``, ``comparisons`` and
``artifacts``; a table is named by ``path`` and given with its row order.

* ``csv_column``: a statistic (mean, std, last, relative_drift_abs_max) of a column within a window, under a threshold.
* ``summary_observable``: ``error_column`` (rel_error_pct) of the first row of an observable.
* ``msd_fit``: slope / 6 (D) and r2 of a line through ``msd_column`` over ``step_column`` times dt.
* ``summary_table``: two columns of the last row of each observable; a relative error that the table has replaces the computed one, and its limit decides.
* ``paired_csv_column``: the same statistic of a column of each of two tables.

Compiling gives rows of rules (one per result, thresholds as columns) and a list of
wanted values, each a column of its table's aggregate: equal wishes are one
column, and windows are conditions on the order, so a table is aggregated by
one scan however many results need it.  Positional windows need the order's
value at their first row; those come from the order column alone.

Defined results: values that are no finite numbers are left out, after windows
are placed by all rows; a line is fitted to rows in which both values are
finite; a metric whose table isn't there is missing_required, or
missing_optional with ``required: false``; comparisons of one are
missing_required, or missing_reference; an observable without row fails as
metric and is missing_observable as comparison; unknown types and statistics
fail.  Rows that share a window's first order value are all in the window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import relative_error, safe_double
from ..operators.filters import finite
from ..operators.scans import row_numbers

STATISTICS = ("mean", "std", "last", "relative_drift_abs_max")
_RULE = (
    "no int, kind string, name string, type string, status string, detail string, a string, b string, own string, found string, "
    "free boolean, low double, high double, target double, max_error double, abs_max double, pct_max double, low_text string, high_text string, error_text string, abs_text string, pct_text string, prefix string"
)


@dataclass(frozen=True)
class Wish:
    """A number wanted of a table: a statistic of a column in a window, a part of a line, or a column of an observable's row."""

    table: str
    window: str
    kind: str
    column: str
    other: str = ""


class Plan:
    """Rules and wishes of a case, given the names of the tables that are there."""

    def __init__(self, case: dict, tables: set[str]):
        self.tables, self.rules, self.wishes = tables, [], {}
        for m in case.get("metrics", []):
            self._metric(m)
        for c in case.get("comparisons", []):
            self._comparison(c)

    def _wish(self, *of: str) -> str:
        return self.wishes.setdefault(Wish(*of), f"v{len(self.wishes)}")

    def _rule(self, kind: str, name: str, type_: str | None, status: str | None = None, detail: str = "", limits: dict | None = None, **values) -> None:
        t = limits or {}
        number = lambda k: None if t.get(k) is None else float(t[k])
        both = "target" in t and "max_abs_error" in t
        row = {
            "no": len(self.rules), "kind": kind, "name": name, "type": type_, "status": status, "detail": detail, "free": limits is None, "low": number("min"), "high": number("max"),
            "target": number("target") if both else None, "max_error": number("max_abs_error") if both else None, "abs_max": number("abs_error_max"), "pct_max": number("rel_error_pct_max"),
            "low_text": f">= {t['min']}" if "min" in t else None, "high_text": f"<= {t['max']}" if "max" in t else None, "error_text": f"|value - {t['target']}| <= {t['max_abs_error']}" if both else None,
            "abs_text": f"abs_error <= {t['abs_error_max']}" if "abs_error_max" in t else None, "pct_text": f"rel_error_pct <= {t['rel_error_pct_max']}" if "rel_error_pct_max" in t else None,
        }
        self.rules.append(row | values)

    def _metric(self, m: dict) -> None:
        name, type_, path, window, limits = m.get("name", "unnamed"), m.get("type"), m.get("path"), m.get("window") or "all", m.get("threshold")
        if type_ not in ("csv_column", "summary_observable", "msd_fit"):
            self._rule("check", name, type_, "fail", f"unknown metric type {type_}")
        elif path not in self.tables:
            self._rule("check", name, type_, "missing_required" if m.get("required", True) else "missing_optional", f"missing {path}")
        elif type_ == "csv_column":
            stat = m.get("stat", "mean")
            if stat in STATISTICS:
                self._rule("check", name, type_, limits=limits, detail=f"no numeric values in {path}:{m['column']}", a=self._wish(path, window, stat, m["column"]))
            else:
                self._rule("check", name, type_, "fail", f"unknown stat {stat}")
        elif type_ == "summary_observable":
            of = (m["observable"], m.get("error_column", "rel_error_pct"))
            self._rule("check", name, type_, limits=limits, detail=f"observable {of[0]} not found", a=self._wish(path, "all", "first_row", *of[::-1]), found=self._wish(path, "all", "rows", "", of[0]))
        else:
            line, limits = (m["msd_column"], m["step_column"]), limits or {}
            slope = self._wish(path, window, f"slope*{float(m.get('dt', 1.0))!r}", *line)
            if "r2" in m.get("outputs", ["r2"]):
                at_least = limits.get("r2_min", -math.inf)
                self._rule("check", f"{name}.r2", type_, limits={"min": at_least}, a=self._wish(path, window, "r2", *line))
            if "D" in m.get("outputs", ["D"]):
                self._rule("check", f"{name}.D", type_, limits={k[2:]: limits[k] for k in ("D_min", "D_max") if k in limits}, a=slope)

    def _comparison(self, c: dict) -> None:
        type_, window = c.get("type"), c.get("window") or "all"
        if type_ == "summary_table":
            path, columns = c["path"], (c.get("value_column", "value"), c.get("reference_column", "reference"))
            for o in c.get("observables", []):
                limits = o.get("threshold")
                if path not in self.tables:
                    self._rule("comparison", o["name"], type_, "missing_required" if c.get("required", True) else "missing_reference", f"missing comparison table {path}", limits)
                    continue
                last = [self._wish(path, "all", "last_row", x, o["name"]) for x in (*columns, c.get("error_column", "rel_error_pct"))]
                found = self._wish(path, "all", "rows", "", o["name"])
                self._rule("comparison", o["name"], type_, limits=limits, detail=f"{o['name']} not found in {path}", a=last[0], b=last[1], own=last[2], found=found)
        elif type_ == "paired_csv_column":
            stat, prefix, sides = c.get("stat", "mean"), "", {}
            if stat not in STATISTICS:
                self._rule("comparison", c["name"], type_, "fail", f"unknown stat {stat}")
                return
            for key, side, text in (("a", "left", "value"), ("b", "right", "reference")):
                if c[f"{side}_path"] in self.tables:
                    sides[key] = self._wish(c[f"{side}_path"], window, stat, c[f"{side}_column"])
                else:
                    prefix += f"missing {text} table {c[f'{side}_path']}; "
            self._rule("comparison", c["name"], type_, limits=c.get("threshold"), prefix=prefix, **sides)
        else:
            self._rule("comparison", c.get("name", "unnamed"), type_, "fail", f"unknown comparison type {type_}")


def first_of_windows(df: DataFrame, order: str, windows: list[str]) -> dict[str, object]:
    """The order's value at the first row of every positional window, from the order column alone."""
    wanted = [w for w in windows if w != "all"]
    if not wanted:
        return {}
    n = df.count()
    starts = {}
    for w in wanted:
        if w == "second_half":
            starts[w] = n // 2
        elif w == "last_80_percent":
            starts[w] = n // 5
        elif w.startswith("last_fraction:"):
            starts[w] = min(max(math.floor(n * (1 - float(w.split(":", 1)[1]))), 0), max(n - 1, 0))
        else:
            raise ValueError(f"unknown window {w!r}")
    rows = row_numbers(df.select(order), order, "__rn").where(F.col("__rn").isin(sorted(set(starts.values())))).collect()  # a row a window
    at = {r["__rn"]: r[order] for r in rows}
    return {w: at.get(i) for w, i in starts.items()}


def _value(w: Wish, order: str, inside: Column, columns: set[str]) -> Column:
    none = F.lit(None).cast("double")
    if w.kind in ("first_row", "last_row", "rows"):
        if "observable" not in columns:
            return F.lit(0.0) if w.kind == "rows" else none
        mine = inside & (F.col("observable") == w.other)
        if w.kind == "rows":
            return F.count(F.when(mine, 1)).cast("double")
        pick = F.min_by if w.kind == "first_row" else F.max_by
        return pick(safe_double(F.col(w.column)), F.when(mine, F.col(order))) if w.column in columns else none
    if w.column not in columns or w.other and w.other not in columns:
        return none
    v = safe_double(F.col(w.column))
    v = F.when(inside & finite(v), v)
    place = F.when(v.isNotNull(), F.col(order))
    if w.kind == "mean":
        return F.avg(v)
    if w.kind == "std":
        return F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0)
    if w.kind == "last":
        return F.max_by(v, place)
    if w.kind == "relative_drift_abs_max":
        first = F.min_by(v, place)
        return F.greatest(F.max(v) - first, first - F.min(v)) / F.greatest(F.abs(first), F.lit(1e-12))
    x = safe_double(F.col(w.other)) * float(w.kind.split("*")[1]) if w.kind.startswith("slope") else safe_double(F.col(w.other))
    x = F.when(v.isNotNull() & finite(x), x)
    y = F.when(x.isNotNull(), v)
    if w.kind == "r2":
        return F.when(F.regr_sxx(y, x) > 0, F.when(F.regr_syy(y, x) == 0, 1.0).otherwise(F.regr_r2(y, x)))
    return F.when(F.regr_sxx(y, x) > 0, F.regr_slope(y, x) / 6)


def values(plan: Plan, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, value): a row per wish, by one aggregate of every table."""
    out = None
    for name in sorted({w.table for w in plan.wishes}):
        df, order = tables[name]
        mine = {w: key for w, key in plan.wishes.items() if w.table == name}
        firsts = first_of_windows(df, order, sorted({w.window for w in mine}))
        inside = lambda w: F.col(order) >= F.lit(firsts[w]) if w in firsts else F.lit(True)
        row = df.agg(*(_value(w, order, inside(w.window), set(df.columns)).alias(key) for w, key in mine.items()))
        pairs = F.explode(F.array(*(F.struct(F.lit(key).alias("key"), F.col(key).cast("double").alias("value")) for key in mine.values())))
        got = row.select(pairs.alias("x")).select("x.*")
        out = got if out is None else out.unionByName(got)
    return out


def judged(spark: SparkSession, plan: Plan, found: DataFrame | None) -> DataFrame:
    """kind, name, status, value, reference, abs_error, rel_error_pct, detail of every rule, in the case's order (no)."""
    names = [c.strip().split()[0] for c in _RULE.split(",")]
    rules = spark.createDataFrame([tuple(r.get(c) for c in names) for r in plan.rules], _RULE)
    found = spark.createDataFrame([], "key string, value double") if found is None else found
    for c, out in (("a", "x"), ("b", "y"), ("own", "z"), ("found", "rows")):
        rules = rules.join(F.broadcast(found.select(F.col("key").alias(c), F.col("value").alias(out))), c, "left")  # a row a wish
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    good = lambda c: F.coalesce(finite(c), F.lit(False))
    absent = F.col("rows") == 0

    def verdict(checks: list[tuple[str, Column]], none: str) -> tuple[Column, Column]:
        asked = [(F.col(t).isNotNull(), ok, F.col(t)) for t, ok in checks]
        failed = F.concat_ws("; ", *(F.when(a & ~ok, t) for a, ok, t in asked))
        any_ = F.coalesce(*(F.when(a, F.lit(True)) for a, _, _ in asked), F.lit(False))
        status = F.when(~any_, "info").when(failed != "", "fail").otherwise("pass")
        return status, F.when(~any_, none).when(failed != "", failed).otherwise(F.concat_ws("; ", *(F.when(a, t) for a, _, t in asked)))

    limit = verdict([("low_text", x >= F.col("low")), ("high_text", x <= F.col("high")), ("error_text", F.abs(x - F.col("target")) <= F.col("max_error"))], "threshold has no scalar rule")
    empty = x.isNull() & (F.col("type") == "csv_column")
    metric = (
        F.when(empty, "fail").when(F.col("free"), "info").when(~good(x), "fail").otherwise(limit[0]),
        F.when(empty, F.col("detail")).when(F.col("free"), "no threshold").when(~good(x), "value is not finite").otherwise(limit[1]),
    )

    error, pct = F.abs(x - y), relative_error(x, y)
    both = verdict([("abs_text", error <= F.col("abs_max")), ("pct_text", pct <= F.col("pct_max"))], "no threshold")
    prefix = F.coalesce("prefix", F.lit(""))
    by_own = good(z) & F.col("pct_text").isNotNull()
    own = F.when(z <= F.col("pct_max"), "pass").otherwise("fail")
    status = F.when(absent, "missing_observable").when(by_own, own).when(~good(x), "missing_value").when(~good(y), "missing_reference").otherwise(both[0])
    detail = F.when(absent, F.col("detail")).when(by_own, F.col("pct_text")).when(~good(x), F.concat(prefix, F.lit("value is missing"))).when(~good(y), F.concat(prefix, F.lit("reference is missing")))
    compared = (status, detail.otherwise(F.concat(prefix, both[1])))

    check = F.col("kind") == "check"
    there = ~check & good(x) & good(y)
    return rules.select(
        "no", "kind", "name", F.coalesce("status", F.when(check & absent, "fail").when(check, metric[0]).otherwise(compared[0])).alias("status"), F.when(good(x), x).alias("value"), F.when(~check & good(y), y).alias("reference"),
        F.when(there, error).alias("abs_error"), F.when(~check & good(z), z).when(there, pct).alias("rel_error_pct"),
        F.when(F.col("status").isNotNull(), F.col("detail")).when(check & absent, F.col("detail")).when(check, metric[1]).otherwise(compared[1]).alias("detail"),
    )


def evaluate(spark: SparkSession, case: dict, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All results of a case; ``tables`` has each table with the column of its row order."""
    plan = Plan(case, set(tables))
    return judged(spark, plan, values(plan, tables) if plan.wishes else None)


def artifacts(spark: SparkSession, case: dict, listing: DataFrame) -> DataFrame:
    """name, path, required, status, size_bytes of the files that a case expects, by a listing (path, length)."""
    rows = spark.createDataFrame([(a["name"], a["path"], bool(a.get("required", True))) for a in case.get("artifacts", [])], "name string, path string, required boolean")
    status = F.when(F.col("length").isNotNull(), "present").when(F.col("required"), "missing_required").otherwise("missing_optional")
    return F.broadcast(rows).join(listing.select("path", "length"), "path", "left").select("name", "path", "required", status.alias("status"), F.coalesce("length", F.lit(0)).alias("size_bytes"))


def passed(results: DataFrame, files: DataFrame | None = None) -> bool:
    """False if a metric failed or is missing though required, a comparison failed, or a required file is missing."""
    bad = results.where("kind = 'check' and status in ('fail', 'missing_required') or kind = 'comparison' and status = 'fail'")
    return not bad.limit(1).count() and (files is None or not files.where("status = 'missing_required'").limit(1).count())


def run_case(spark: SparkSession, case: dict, tables: dict[str, tuple[DataFrame, str]], steps: dict | None = None, out: str | None = None, listing: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(results, whether the case passed); ``run_steps`` that name a function of ``steps`` add its tables first, and ``out`` gets the results as CSV."""
    for step in case.get("run_steps", []):
        if steps and step["name"] in steps:
            tables = tables | steps[step["name"]](spark, tables)
    results = evaluate(spark, case, tables)
    files = artifacts(spark, case, listing) if listing is not None and case.get("artifacts") else None
    if out:
        from ..sources.sinks import write_csv

        fields = ["kind", "name", "status", "value", "reference", "abs_error", "rel_error_pct", "detail"]
        write_csv(results.where("kind = 'check'").orderBy("no"), f"{out}/check_metrics", ["name", "status", "value", "detail"])
        write_csv(results.where("kind = 'comparison'").orderBy("no"), f"{out}/comparison_metrics", [f for f in fields if f != "kind"])
        write_csv(results.orderBy("no"), f"{out}/metrics", fields)
        if files is not None:
            write_csv(files, f"{out}/artifacts", files.columns)
    return results, passed(results, files)

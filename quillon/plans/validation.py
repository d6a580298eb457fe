"""Declarative validation: a case lists metrics and comparisons; results are rows with a status.

Metric types: csv_column (window, column, statistic, threshold),
summary_observable (first row of an observable), msd_fit (slope / 6 and r2 of a
line).  Comparison types: summary_table, paired_csv_column.  Types are entries
of a registry, unknown ones give a failed row.  Missing input is a status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import check_threshold, compare_values, safe_double
from ..operators.aggregates import linear_fit, sample_std
from ..operators.filters import finite
from ..operators.scans import row_window

RESULT = "name string, value double, status string, detail string"
METRICS: dict[str, Callable[[DataFrame, dict], list[DataFrame]]] = {}
COMPARISONS: dict[str, Callable[[dict[str, DataFrame], dict], DataFrame]] = {}


def _statistic(name: str, v: str, order: str) -> Column | None:
    first = F.min_by(v, order)
    return {
        "mean": F.avg(v), "std": sample_std(v), "min": F.min(v), "max": F.max(v), "last": F.max_by(v, order),
        "relative_drift": F.greatest(F.max(v) - first, first - F.min(v)) / F.greatest(F.abs(first), F.lit(1e-12)),
    }.get(name)


def _limits(rule: dict | None) -> dict:
    rule = rule or {}
    return {"low": rule.get("min"), "high": rule.get("max"), "target": rule.get("target"), "max_abs_error": rule.get("max_abs_error")}


def _judged(df: DataFrame, name: str, value: str, rule: dict | None) -> DataFrame:
    status, detail = check_threshold(F.col(value), **_limits(rule))
    empty = F.col(value).isNull()
    return df.select(
        F.lit(name).alias("name"), F.col(value).cast("double").alias("value"), F.when(empty, "fail").otherwise(status).alias("status"),
        F.when(empty, "no numeric rows").otherwise(detail).alias("detail"),
    )


def _row(spark: SparkSession, name: str, status: str, detail: str) -> DataFrame:
    return spark.createDataFrame([(name, None, status, detail)], RESULT)


def csv_column(table: DataFrame, metric: dict) -> list[DataFrame]:
    order = metric.get("order", "step")
    rows = row_window(table, metric.get("window", "all"), order).select(F.col(order).alias("o"), safe_double(F.col(metric["column"])).alias("v")).where(finite("v"))
    value = _statistic(metric.get("stat", "mean"), "v", "o")
    if value is None:
        return [_row(table.sparkSession, metric["name"], "fail", f"unknown statistic {metric['stat']}")]
    return [_judged(rows.agg(value.alias("value")), metric["name"], "value", metric.get("threshold"))]


def summary_observable(table: DataFrame, metric: dict) -> list[DataFrame]:
    order = metric.get("order", "row" if "row" in table.columns else "observable")
    row = table.where(F.col("observable") == metric["observable"]).agg(F.min_by(safe_double(F.col(metric.get("column", "value"))), order).alias("value"))
    return [_judged(row, metric["name"], "value", metric.get("threshold"))]


def msd_fit(table: DataFrame, metric: dict) -> list[DataFrame]:
    """Rows in which time or displacement isn't finite are left out together, so pairs stay aligned."""
    order = metric.get("order", "step")
    rows = row_window(table, metric.get("window", "last_80_percent"), order)
    fit = linear_fit(rows.select(safe_double(F.col(metric["x"])).alias("x"), safe_double(F.col(metric["y"])).alias("y")), "x", "y")
    fit = fit.select((F.col("slope") / 6).alias("d"), "r2")
    rules = metric.get("thresholds", {})
    return [_judged(fit, f"{metric['name']}.r2", "r2", rules.get("r2")), _judged(fit, f"{metric['name']}.D", "d", rules.get("D"))]


METRICS |= {"csv_column": csv_column, "summary_observable": summary_observable, "msd_fit": msd_fit}


def summary_table(tables: dict[str, DataFrame], c: dict) -> DataFrame:
    """Observables of two summaries, of duplicates the last row (by column ``row``)."""
    spark = next(iter(tables.values())).sparkSession
    side = lambda name, out: tables[name].groupBy("observable").agg(F.max_by(safe_double(F.col("value")), "row").alias(out))
    asked = spark.createDataFrame([(o["name"], o.get("max_abs_error"), o.get("max_rel_pct")) for o in c["observables"]], "name string, max_abs double, max_pct double")
    both = F.broadcast(asked).join(side(c["left"], "value").withColumnRenamed("observable", "name"), "name", "left")
    both = both.join(side(c["right"], "reference").withColumnRenamed("observable", "name"), "name", "left")
    return _compared(both)


def paired_csv_column(tables: dict[str, DataFrame], c: dict) -> DataFrame:
    """One statistic of a column of each of two tables."""

    def one(name: str, out: str) -> DataFrame:
        order = c.get("order", "step")
        rows = row_window(tables[name], c.get("window", "all"), order).select(F.col(order).alias("o"), safe_double(F.col(c["column"])).alias("v")).where(finite("v"))
        return rows.agg(_statistic(c.get("stat", "mean"), "v", "o").alias(out))

    both = one(c["left"], "value").crossJoin(one(c["right"], "reference"))
    limits = {"max_abs": c.get("max_abs_error"), "max_pct": c.get("max_rel_pct")}
    return _compared(both.select(F.lit(c["name"]).alias("name"), "value", "reference", *(F.lit(v).cast("double").alias(k) for k, v in limits.items())))


def _compared(both: DataFrame) -> DataFrame:
    v, r = F.col("value"), F.col("reference")
    error, pct, status = compare_values(v, r)
    ok = (F.coalesce(error <= F.col("max_abs"), F.lit(True))) & (F.coalesce(pct <= F.col("max_pct"), F.lit(True)))
    limited = F.col("max_abs").isNotNull() | F.col("max_pct").isNotNull()
    final = F.when(status != "info", status).when(~limited, "info").when(ok, "pass").otherwise("fail")
    return both.select("name", v.cast("double").alias("value"), r.cast("double").alias("reference"), error.alias("abs_error"), pct.alias("rel_error_pct"), final.alias("status"))


COMPARISONS |= {"summary_table": summary_table, "paired_csv_column": paired_csv_column}


def evaluate_metrics(spark: SparkSession, tables: dict[str, DataFrame], metrics: list[dict]) -> DataFrame:
    out = spark.createDataFrame([], RESULT)
    for m in metrics:
        if m.get("type") not in METRICS:
            rows = [_row(spark, m["name"], "fail", f"unknown metric type {m.get('type')}")]
        elif m.get("table") not in tables:
            rows = [_row(spark, m["name"], "missing_required" if m.get("required", True) else "missing_optional", f"no table {m.get('table')}")]
        else:
            rows = METRICS[m["type"]](tables[m["table"]], m)
        for r in rows:
            out = out.unionByName(r)
    return out


def evaluate_comparisons(spark: SparkSession, tables: dict[str, DataFrame], comparisons: list[dict]) -> DataFrame:
    kind = "name string, value double, reference double, abs_error double, rel_error_pct double, status string"
    out = spark.createDataFrame([], kind)
    for c in comparisons:
        if c.get("type") not in COMPARISONS:
            row = spark.createDataFrame([(c["name"], None, None, None, None, "fail")], kind)
        elif c["left"] not in tables or c["right"] not in tables:
            row = spark.createDataFrame([(c["name"], None, None, None, None, "missing_required")], kind)
        else:
            row = COMPARISONS[c["type"]](tables, c)
        out = out.unionByName(row)
    return out


def artifacts(spark: SparkSession, wanted: list[dict], listing: DataFrame) -> DataFrame:
    """present with its length, missing_required or missing_optional for each path."""
    rows = spark.createDataFrame([(a["path"], a.get("required", True)) for a in wanted], "path string, required boolean")
    status = F.when(F.col("length").isNotNull(), "present").when(F.col("required"), "missing_required").otherwise("missing_optional")
    return F.broadcast(rows).join(listing.select("path", "length"), "path", "left").select("path", "length", status.alias("status"))


def exit_code(metrics: DataFrame, comparisons: DataFrame) -> int:
    """1 if a metric failed or is missing, or a comparison failed; a missing comparison doesn't count."""
    bad = metrics.where(F.col("status").isin("fail", "missing_required")).limit(1).count() + comparisons.where("status = 'fail'").limit(1).count()
    return int(bad > 0)


def run_case(spark: SparkSession, case: dict, tables: dict[str, DataFrame]) -> tuple[DataFrame, int]:
    """All rows of a case with their kind, and the exit code."""
    from ..operators.relations import tagged_union

    m = evaluate_metrics(spark, tables, case.get("metrics", []))
    c = evaluate_comparisons(spark, tables, case.get("comparisons", []))
    return tagged_union({"check": m, "comparison": c}), exit_code(m, c)

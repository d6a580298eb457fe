"""Threshold checks and comparisons of values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import finite


def safe_double(v: Column) -> Column:
    """A number, or NaN for what is none."""
    return F.coalesce(v.try_cast("double"), F.lit(float("nan")))


def check_threshold(value: Column, low: float | None = None, high: float | None = None, target: float | None = None, max_abs_error: float | None = None) -> tuple[Column, Column]:
    """(status, detail): info without any rule, fail for a value that isn't finite, else pass if all rules hold.

    The detail lists the rules that failed, or all of them if none did.
    """
    rules: list[tuple[str, Column]] = []
    if low is not None:
        rules.append((f">= {low:g}", value >= low))
    if high is not None:
        rules.append((f"<= {high:g}", value <= high))
    if target is not None and max_abs_error is not None:
        rules.append((f"|value - {target:g}| <= {max_abs_error:g}", F.abs(value - target) <= max_abs_error))
    if not rules:
        return F.lit("info"), F.lit("no threshold")
    every = F.lit(True)
    for _, ok in rules:
        every = every & ok
    failed = F.concat_ws("; ", *(F.when(~ok, F.lit(text)) for text, ok in rules))
    good = finite(value)
    status = F.when(~good, "fail").when(every, "pass").otherwise("fail")
    return status, F.when(~good, "not finite").when(every, F.lit("; ".join(t for t, _ in rules))).otherwise(failed)


def relative_error(a: Column, b: Column) -> Column:
    """Per cent of max(|b|, 1e-12); 0 where both are 0."""
    return F.when((a == 0) & (b == 0), 0.0).otherwise(100 * F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12)))


def compare_values(value: Column, reference: Column, max_abs: float | None = None, max_pct: float | None = None) -> tuple[Column, Column, Column]:
    """(absolute error, relative error, status): missing_value, missing_reference, info without limits, pass or fail."""
    error, pct = F.abs(value - reference), relative_error(value, reference)
    ok = F.lit(True)
    if max_abs is not None:
        ok = ok & (error <= max_abs)
    if max_pct is not None:
        ok = ok & (pct <= max_pct)
    status = F.when(~F.coalesce(finite(value), F.lit(False)), "missing_value").when(~F.coalesce(finite(reference), F.lit(False)), "missing_reference")
    if max_abs is None and max_pct is None:
        return error, pct, status.otherwise("info")
    return error, pct, status.when(ok, "pass").otherwise("fail")

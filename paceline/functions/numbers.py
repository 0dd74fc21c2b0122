"""Runtime arithmetic where infinity marks a failure and NaN must not leak."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import as_column, finite_number

INFINITY = float("inf")
# The speedup thresholds of the report and the bands of the distribution.
REPORT_THRESHOLDS = (1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)
SPEEDUP_BANDS = (10.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.1)


def threshold_name(value: float) -> str:
    """`1.25` → `1_25`, for column names."""
    return f"{value:g}".replace(".", "_")


def nan_to_null(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """IEEE division: x/0 is ±infinity and 0/0 is NaN, where ANSI division would raise."""
    numerator, denominator = as_column(numerator), as_column(denominator)
    by_zero = F.when(numerator > 0, F.lit(INFINITY)).when(numerator < 0, F.lit(-INFINITY)).otherwise(F.lit(float("nan")))
    by_zero = F.when(F.isnan(numerator), F.lit(float("nan"))).otherwise(by_zero)
    return F.coalesce(
        F.try_divide(numerator, denominator),
        F.when(numerator.isNotNull() & (denominator == 0), by_zero),
    )


def floored_speedup(slow: Column | str, fast: Column | str) -> Column:
    """Speedup of at least 1; NaN (failed over failed) and null count as 1.

    Runtimes are not negative, so only a slow runtime above the fast one needs dividing. The
    short form matters: report stages use it many times over in one generated method.
    """
    slow, fast = as_column(slow), as_column(fast)
    speedup = F.coalesce(F.try_divide(slow, fast), F.lit(INFINITY))
    return F.when((slow > fast) & ~F.isnan(slow), speedup).otherwise(F.lit(1.0))


def adjusted_runtime(
    runtime: Column | str, accuracy: Column | str, code: Column | str, threshold: float = 1.0
) -> Column:
    """Infinity when there is no code or its accuracy is under the threshold."""
    failed = as_column(code).isNull() | (as_column(accuracy) < threshold)
    return F.when(failed, F.lit(INFINITY)).otherwise(as_column(runtime))


def grade_lines(actual: Column | str, expected: Column | str, tolerance: float = 1e-3) -> Column:
    """M1: share of expected lines met by position, as text or as numbers; null without expected lines."""
    actual, expected = as_column(actual), as_column(expected)

    def met(got: Column, wanted: Column) -> Column:
        close = F.abs(finite_number(got) - finite_number(wanted)) < tolerance
        return F.coalesce(got == wanted, F.lit(False)) | F.coalesce(close, F.lit(False))

    matches = F.filter(F.zip_with(actual, expected, met), lambda hit: hit)
    return F.try_divide(F.size(matches).cast("double"), F.size(expected))


def submission_score(compiled: Column | str, accuracy: Column | str, runtime: Column | str) -> Column:
    """Half accuracy, half inverse runtime; 0 if not compiled, null at runtime 0."""
    return F.when(~as_column(compiled), F.lit(0.0)).otherwise(
        as_column(accuracy) * 0.5 + F.try_divide(F.lit(1.0), as_column(runtime)) * 0.5
    )

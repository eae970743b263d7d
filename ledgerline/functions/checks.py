"""User checks: functions from tables to issues, under a code and a severity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.reconcile import ISSUE, SEVERITIES

Check = Callable[[DataFrame], DataFrame]
_CHECKS: dict[str, tuple[str, Check]] = {}


def register_check(code: str, severity: str, fn: Check) -> Check:
    """Register fn, which gives (run_id, step_code, expected_value, actual_value) rows for what is wrong."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity {severity!r} is none of {SEVERITIES}")
    if code in _CHECKS:
        raise ValueError(f"check {code!r} is registered already")
    _CHECKS[code] = (severity, fn)
    return fn


def run_check(code: str, df: DataFrame) -> DataFrame:
    """Issues of one check in the issue schema; a result that lacks a column raises."""
    severity, fn = _CHECKS[code]
    found = fn(df)
    columns = {"issue_code": F.lit(code), "severity": F.lit(severity), "detected_at": F.current_timestamp()}
    wanted = [x.strip().split(" ") for x in ISSUE.split(",")]
    if lacking := [n for n, _ in wanted if n not in columns and n not in found.columns]:
        raise ValueError(f"check {code!r} gives no {', '.join(lacking)}")
    return found.select(*(columns.get(n, F.col(n) if n in found.columns else None).cast(t).alias(n) for n, t in wanted))

"""Record validation: split a table into valid rows and quarantined rows with reasons."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.columns import numeric


@dataclass(frozen=True)
class Constraint:
    """A required field, optionally bounded. ``above`` is a strict lower bound."""

    field: str
    low: float | None = None
    high: float | None = None
    above: float | None = None
    text: bool = False


# The bounds of a credit record.
CREDIT_CONSTRAINTS = (
    Constraint("age", 18, 120),
    Constraint("annual_income", 0),
    Constraint("credit_score", 300, 850),
    Constraint("debt_to_income_ratio", 0.0, 3.0),
    Constraint("loan_amount", above=0),
    Constraint("interest_rate", 0.0, 50.0),
    Constraint("home_ownership", text=True),
    Constraint("loan_intent", text=True),
    Constraint("employment_history_length", 0.0, 70.0),
)


def violation_reasons(df: DataFrame, constraints: Iterable[Constraint]) -> Column:
    """Array of ``field:reason`` texts; empty for a valid row."""
    checks = []
    for c in constraints:
        if c.field not in df.columns:
            checks.append(F.lit(f"{c.field}:missing"))
            continue
        raw = F.col(f"`{c.field}`")
        reason = F.when(raw.isNull(), f"{c.field}:missing")
        if not c.text:
            v = numeric(df, c.field)
            reason = reason.when(v.isNull(), f"{c.field}:not_a_number")
            if c.above is not None:
                reason = reason.when(v <= c.above, f"{c.field}:too_low")
            if c.low is not None:
                reason = reason.when(v < c.low, f"{c.field}:too_low")
            if c.high is not None:
                reason = reason.when(v > c.high, f"{c.field}:too_high")
        checks.append(reason)
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate_records(
    df: DataFrame, constraints: Iterable[Constraint] = CREDIT_CONSTRAINTS
) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``; quarantined rows carry ``reasons``."""
    marked = df.withColumn("reasons", violation_reasons(df, constraints))
    valid = marked.filter(F.size("reasons") == 0).drop("reasons")
    return valid, marked.filter(F.size("reasons") > 0)

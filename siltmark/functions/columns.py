"""Column helpers shared by the operators; all stay inside JVM code generation."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed pattern: what counts as a number in text input. Java would also accept
# suffixes such as '1d', which are not numbers here.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def parse_number(column: Column | str, data_type: str = "string") -> Column:
    """Text (or any column) as DOUBLE; NULL where it is not a number."""
    c = F.col(column) if isinstance(column, str) else column
    if data_type == "string":
        text = F.when(c.rlike(NUMBER_PATTERN), F.trim(c))
        return text.try_cast("double")
    return nan_to_null(c.cast("double"))


def nan_to_null(column: Column) -> Column:
    """NaN and NULL are one concept (missing); -0.0 and 0.0 one value."""
    return F.nanvl(column, F.lit(None).cast("double")) + F.lit(0.0)


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a clean DOUBLE."""
    kind = df.schema[name].dataType.simpleString()
    if kind == "string":
        return parse_number(F.col(f"`{name}`"), kind)
    return F.expr(f"nanvl(CAST(`{name}` AS DOUBLE), CAST(NULL AS DOUBLE)) + 0D")


def rounded(column: Column, digits: int) -> Column:
    """Round and normalise -0.0."""
    return F.round(column, digits) + F.lit(0.0)


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, (list, tuple)):
        return f"CAST(array({', '.join(_literal(v, 'string') if isinstance(v, str) else repr(v) for v in value)}) AS {kind})"
    if isinstance(value, str):
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {kind})"
    return f"CAST({value!r} AS {kind})"


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few configuration rows as a literal relation: no job, and its size is known."""
    fields = [tuple(part.split(None, 1)) for part in schema.split(", ")]
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join(
        "(" + ", ".join(_literal(v, kind) for v, (_, kind) in zip(row, fields)) + ")" for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")


def fixed(column: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded on the exact binary value."""
    return F.call_function("format_number", column, F.lit("0." + "0" * digits))


def wrapped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns inside structs: a NULL key then groups and joins like any other value."""
    return df.withColumns({k: F.struct(F.col(k).alias("key")) for k in keys}) if keys else df


def unwrapped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: F.col(k)["key"] for k in keys}) if keys else df


def null_safe_keys(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators with arguments ``cur`` and ``keys``: NULL segments and windows are groups of their own."""
    signature = inspect.signature(operator)

    @wraps(operator)
    def call(*args, **options) -> DataFrame:
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        keys = list(bound.arguments["keys"])
        bound.arguments["cur"] = wrapped(bound.arguments["cur"], keys)
        return unwrapped(operator(*bound.args, **bound.kwargs), keys)

    return call

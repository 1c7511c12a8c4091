"""From raw tables to the canonical schema: rename, derive, map, default, coerce, order.

Each step is a ``DataFrame -> DataFrame`` function; Catalyst collapses the chain
into narrow projections over the scan: no shuffle, no Python.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import Feature, load_mapping
from siltmark.functions.columns import numeric, rounded

# The tracking columns, prediction columns and neutral fillers.
TRACKING = ("request_id", "timestamp", "source_id")
PREDICTION = ("prediction_score", "prediction_label")
UNKNOWN = "UNKNOWN"
DEFAULT_SOURCE = "adapter_ingest"

_QUOTED = re.compile(r"('[^']*'|\"[^\"]*\"|`[^`]*`)")
_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d*|\.\d+)(?![\w.])")
_WHITESPACE = " \t\n\r\x0b\x0c"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename what exists; names that are not there are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def derivation_list(derivations: Any) -> list[tuple[str, str]]:
    """Accept ``{target: expression}`` or a list of target_column/expression entries."""
    if isinstance(derivations, Mapping):
        return list(derivations.items())
    return [
        (d["target_column"], d["expression"])
        for d in derivations or []
        if isinstance(d, Mapping) and "target_column" in d and "expression" in d
    ]


def derive_columns(
    df: DataFrame, derivations: Any, only_if_missing: bool = False
) -> DataFrame:
    """Evaluate SQL expressions in order; later ones may use earlier ones.

    An expression that cannot be analysed is reported and skipped. Results of
    decimal arithmetic (integer columns with decimal literals) become DOUBLE.
    """
    for target, expression in derivation_list(derivations):
        if only_if_missing and target in df.columns:
            continue
        try:
            value = F.expr(expression)
            kind = df.select(value.alias("v")).schema["v"].dataType
        except (AnalysisException, ParseException) as e:
            warnings.warn(f"derivation {target} = {expression} skipped: {e}", stacklevel=2)
            continue
        if isinstance(kind, T.DecimalType):
            # Decimal division would round to a fixed scale: use double literals.
            value = F.expr(double_literals(expression)).cast("double")
        df = df.withColumn(target, value)
    return df


def double_literals(expression: str) -> str:
    """Mark decimal literals outside quotes as DOUBLE (``100.0`` -> ``100.0D``)."""
    parts = _QUOTED.split(expression)
    return "".join(p if i % 2 else _DECIMAL.sub(r"\1D", p) for i, p in enumerate(parts))


def map_values(df: DataFrame, value_maps: Mapping[str, Mapping[Any, Any]]) -> DataFrame:
    """Replace values: exact match, else match of the trimmed text, else unchanged.

    Numeric keys match numeric cells only; NULL stays NULL.
    """
    out = {}
    for name, mapping in value_maps.items():
        if name in df.columns and mapping:
            out[name] = _mapped(df, name, mapping)
    return df.withColumns(out) if out else df


def _literal_map(pairs: Iterable[tuple[Any, Any]]) -> Column | None:
    items = [F.lit(x) for pair in pairs for x in pair]
    return F.create_map(*items) if items else None


def _mapped(df: DataFrame, name: str, mapping: Mapping[Any, Any]) -> Column:
    kind = df.schema[name].dataType
    c = _c(name)
    keep_numeric = isinstance(kind, T.NumericType) and all(
        isinstance(v, (int, float)) and not isinstance(v, bool) for v in mapping.values()
    )

    def target(v: Any) -> Any:
        return float(v) if keep_numeric else str(v)

    texts = _literal_map((k, target(v)) for k, v in mapping.items() if isinstance(k, str))
    numbers = _literal_map(
        (float(k), target(v)) for k, v in mapping.items()
        if isinstance(k, (int, float)) and not isinstance(k, bool)
    )
    tries = []
    if isinstance(kind, T.NumericType) and numbers is not None:
        tries.append(F.try_element_at(numbers, c.cast("double")))
    if texts is not None:
        text = c.cast("string")
        tries += [
            F.try_element_at(texts, text),
            F.try_element_at(texts, F.btrim(text, F.lit(_WHITESPACE))),
        ]
    return F.coalesce(*tries, c.cast("double" if keep_numeric else "string"))


def apply_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Fill NULLs of present columns, add absent ones as literals."""
    out = {}
    for name, value in defaults.items():
        if name not in df.columns:
            out[name] = F.lit(value)
        elif df.schema[name].dataType == T.DoubleType():
            out[name] = F.coalesce(F.nanvl(_c(name), F.lit(None)), F.lit(value))
        else:
            out[name] = F.coalesce(_c(name), F.lit(value))
    return df.withColumns(out) if out else df


def coerce_features(
    df: DataFrame, features: Iterable[Feature], compat: bool = False
) -> DataFrame:
    """Numerical: number or 0.0. Categorical: text, absent column ``UNKNOWN``.

    ``compat`` writes missing categories as the text ``nan``.
    """
    out = {}
    for f in features:
        if f.name not in df.columns:
            out[f.name] = F.lit(0.0) if f.is_numerical else F.lit(UNKNOWN)
        elif f.is_numerical:
            out[f.name] = F.coalesce(numeric(df, f.name), F.lit(0.0))
        else:
            text = _c(f.name).cast("string")
            out[f.name] = F.coalesce(text, F.lit("nan")) if compat else text
    return df.withColumns(out) if out else df


def coerced_counts(
    df: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """How many cells ``coerce_features`` replaces: ``feature, missing, unparsable``."""
    names = [f.name for f in features if f.is_numerical and f.name in df.columns]
    cells = []
    for n in names:
        gone, bad = _c(n).isNull(), _c(n).isNotNull() & numeric(df, n).isNull()
        cells.append(F.struct(
            F.lit(n).alias("feature"), F.count_if(gone).alias("missing"),
            F.count_if(bad).alias("unparsable"),
        ))
    one = df.groupBy(*keys).agg(F.array(*cells).alias("_a"))
    return one.select(*keys, F.inline("_a"))


def add_tracking(
    df: DataFrame, source_name: str | None = None, now: datetime | str | None = None
) -> DataFrame:
    """``request_id`` (given, record id, or generated), ``timestamp``, ``source_id``."""
    out: dict[str, Column] = {"source_id": F.lit(source_name or DEFAULT_SOURCE)}
    if "request_id" not in df.columns:
        if "record_id" in df.columns:
            out["request_id"] = _c("record_id").cast("string")
        else:
            out["request_id"] = F.concat(
                F.lit("ingest_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10)
            )
    if "timestamp" not in df.columns:
        moment = now.isoformat() if isinstance(now, datetime) else now
        out["timestamp"] = F.lit(moment) if moment else F.date_format(
            F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
        )
    return df.withColumns(out)


def drop_temporary(df: DataFrame) -> DataFrame:
    return df.select(*[_c(c) for c in df.columns if not c.startswith("_")])


def canonical_order(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """Tracking, features, prediction columns, then everything else in place."""
    first = [*TRACKING, *[f.name for f in features], *PREDICTION]
    names = [c for c in first if c in df.columns]
    names += [c for c in df.columns if c not in first]
    return df.select(*[_c(c) for c in names])


def harmonize(
    df: DataFrame,
    mapping: Mapping[str, Any] | str,
    features: Iterable[Feature],
    now: datetime | str | None = None,
    compat: bool = False,
    only_if_missing: bool = False,
) -> DataFrame:
    """The whole chain for one adapter mapping (dict, or YAML/JSON file)."""
    m = load_mapping(mapping)
    features = list(features)
    out = rename_columns(df, m.get("column_mapping") or m.get("column_mappings") or {})
    out = derive_columns(out, m.get("derivations") or {}, only_if_missing)
    out = map_values(out, m.get("value_mappings") or {})
    out = apply_defaults(out, m.get("defaults") or {})
    out = coerce_features(out, features, compat)
    out = add_tracking(out, m.get("source_name"), now)
    return canonical_order(drop_temporary(out), features)


def to_log_record(
    df: DataFrame,
    features: Iterable[Feature],
    model_version: str,
    batch_latency_ms: Column | float | None = None,
    batch_size: Column | int | None = None,
) -> DataFrame:
    """Inference-log projection; absent or missing fields become 0 or ''.

    The latency of a batch is divided evenly over its rows.
    """
    out = [
        _c("request_id").cast("string").alias("request_id"),
        _c("timestamp").cast("string").alias("timestamp"),
        F.lit(model_version).alias("model_version"),
    ]
    for f in features:
        neutral = F.lit(0.0) if f.is_numerical else F.lit("")
        if f.name not in df.columns:
            out.append(neutral.alias(f.name))
        else:
            value = numeric(df, f.name) if f.is_numerical else _c(f.name).cast("string")
            out.append(F.coalesce(value, neutral).alias(f.name))
    latency = F.lit(0.0)
    if batch_latency_ms is not None:
        total = batch_latency_ms if isinstance(batch_latency_ms, Column) else F.lit(batch_latency_ms)
        size = batch_size if isinstance(batch_size, Column) else F.lit(batch_size or 1)
        latency = rounded(total / size, 3)
    return df.select(
        *out, _c("prediction_score").cast("double").alias("prediction_score"),
        _c("prediction_label").cast("long").alias("prediction_label"),
        latency.alias("latency_ms"),
    )

"""Feature catalogue and monitoring rules.

Both are small driver-side objects: the catalogue lists the columns that are
monitored, the rules hold every threshold. Plans are built from them; no data
flows through them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

NUMERICAL = "numerical"
CATEGORICAL = "categorical"

FEATURE_SCHEMA = "feature string, feature_type string, importance string, position int"


@dataclass(frozen=True)
class Feature:
    """One monitored column."""

    name: str
    type: str = NUMERICAL
    importance: str = "medium"
    min: float | None = None
    max: float | None = None
    allowed_values: tuple[str, ...] = ()
    description: str = ""

    @property
    def is_numerical(self) -> bool:
        return self.type == NUMERICAL


# The canonical credit catalogue and its domains.
CREDIT_FEATURES = (
    Feature("age", NUMERICAL, "medium", 18, 100),
    Feature("annual_income", NUMERICAL, "high", 5000, 2000000),
    Feature("credit_score", NUMERICAL, "high", 300, 850),
    Feature("debt_to_income_ratio", NUMERICAL, "high", 0.0, 1.5),
    Feature("loan_amount", NUMERICAL, "high", 1000, 100000),
    Feature("interest_rate", NUMERICAL, "medium", 2.0, 36.0),
    Feature(
        "home_ownership", CATEGORICAL, "medium",
        allowed_values=("RENT", "OWN", "MORTGAGE", "OTHER"),
    ),
    Feature(
        "loan_intent", CATEGORICAL, "high",
        allowed_values=(
            "PERSONAL", "EDUCATION", "MEDICAL", "VENTURE",
            "HOMEIMPROVEMENT", "DEBTCONSOLIDATION",
        ),
    ),
    Feature("employment_history_length", NUMERICAL, "low", 0, 60),
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; the defaults are the documented monitoring policy."""

    psi_warning: float = 0.10
    psi_drift: float = 0.20
    num_bins: int = 10
    epsilon: float = 1e-4
    ks_p_value: float = 0.05
    chi2_p_value: float = 0.05
    prediction_warning: float = 0.10
    prediction_drift: float = 0.15
    max_null_pct: float = 0.05
    critical_null_pct: float = 0.20
    max_oov_pct: float = 0.02
    max_out_of_range_pct: float = 0.01
    min_samples: int = 100
    window_hours: int = 6
    prediction_column: str = "prediction_score"
    label_column: str = "prediction_label"
    severe_feature_count: int = 2
    trigger_on_prediction_drift: bool = True
    high_importance_psi: float = 0.25
    retrain_mode: str = "threshold_approval"
    cooldown_hours: int = 12
    quality_cooldown_hours: int = 6
    auc_tolerance: float = 0.03

    @classmethod
    def from_dict(cls, nested: Mapping[str, Any] | None) -> Rules:
        """Build rules from the nested rules file; absent entries keep defaults."""
        nested = nested or {}
        known = {f.name for f in fields(cls)}
        found = {}
        for path, name in _RULE_PATHS.items():
            node: Any = nested
            for part in path.split("."):
                node = node.get(part) if isinstance(node, Mapping) else None
            if node is not None:
                found[name] = node
        found.update({k: v for k, v in nested.items() if k in known})
        return cls(**found)


# Where each threshold sits in the nested rules file.
_RULE_PATHS = {
    "monitoring.batch_window_hours": "window_hours",
    "monitoring.min_samples": "min_samples",
    "monitoring.prediction_column": "prediction_column",
    "monitoring.label_column": "label_column",
    "metrics.psi.no_drift": "psi_warning",
    "metrics.psi.moderate_drift": "psi_drift",
    "metrics.psi.num_bins": "num_bins",
    "metrics.psi.epsilon": "epsilon",
    "metrics.ks_test.p_value_threshold": "ks_p_value",
    "metrics.chi2_test.p_value_threshold": "chi2_p_value",
    "metrics.prediction_drift.psi_threshold": "prediction_drift",
    "quality.max_null_pct": "max_null_pct",
    "quality.max_oov_pct": "max_oov_pct",
    "alerting.cooldown_hours": "cooldown_hours",
    "retraining.mode": "retrain_mode",
    "retraining.trigger_conditions.severe_drift_feature_count": "severe_feature_count",
    "retraining.trigger_conditions.trigger_on_prediction_drift": "trigger_on_prediction_drift",
}


def parse_features(document: Mapping[str, Any]) -> tuple[Feature, ...]:
    known = {f.name for f in fields(Feature)}
    return tuple(
        Feature(**{k: tuple(v) if k == "allowed_values" else v
                   for k, v in entry.items() if k in known})
        for entry in document.get("features", [])
    )


def load_features(path: str) -> tuple[Feature, ...]:
    """Read a JSON feature catalogue."""
    return parse_features(json.loads(Path(path).read_text(encoding="utf-8")))


def load_mapping(source: str | Mapping[str, Any]) -> Mapping[str, Any]:
    """A mapping given as a dict, or as a YAML or JSON file."""
    if isinstance(source, Mapping):
        return source
    text = Path(source).read_text(encoding="utf-8")
    if str(source).endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def load_rules(path: str) -> Rules:
    """Read a YAML or JSON rules file."""
    return Rules.from_dict(load_mapping(path))


def numerical(features: Iterable[Feature]) -> list[Feature]:
    return [f for f in features if f.is_numerical]


def categorical(features: Iterable[Feature]) -> list[Feature]:
    return [f for f in features if not f.is_numerical]


def features_table(spark: SparkSession, features: Iterable[Feature]) -> DataFrame:
    """The catalogue as a DataFrame: one row per feature, bounded by the config."""
    rows = [(f.name, f.type, f.importance, i) for i, f in enumerate(features)]
    from siltmark.functions.columns import inline_table

    return inline_table(spark, rows, FEATURE_SCHEMA)

"""Siltmark: data-drift analytics on Spark DataFrames."""

from siltmark.config import Feature, Rules, load_features, load_rules

__all__ = ["Feature", "Rules", "load_features", "load_rules"]

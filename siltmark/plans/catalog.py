"""All registered queries; importing the modules registers them."""

from siltmark.plans import (  # noqa: F401
    queries_drift,
    queries_ingest,
    queries_model,
    queries_runs,
    queries_stream,
)
from siltmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Operators on DataFrames. All are pure: parameters in, DataFrame out; ``as_of`` stands where a clock would."""

from __future__ import annotations

from . import access, aggregates, flags, graph, layout, model_output, processing, queues, reconcile, records, retrieval, timeline

__all__ = ["access", "aggregates", "flags", "graph", "layout", "model_output", "processing", "queues", "reconcile", "records", "retrieval",
    "timeline"]

"""Delivery-performance analytics (in full, on time) as Spark DataFrame jobs.

Layout:
  sources/    table loading, CSV sources and sinks, test fixtures, literal tables
  functions/  Column-returning expressions (haversine, flags, keys, dates)
  operators/  DataFrame -> DataFrame operators (cleaning, joins, KPI, stats, features, models)
  plans/      the end-to-end label / enrichment / model-frame plans and the query catalogue
  streaming/  (empty on purpose: the reference has no stream processing)
  checks/     DuckDB SQL texts that recompute every checkable query independently
"""
from shipshape.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]

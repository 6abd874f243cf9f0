"""All queries of the library, by name, with their SQL for the comparison."""

from __future__ import annotations

from scholia_spark.plans import activity, docmodel, evidence, gates, ingest, records, refine, repair, retrieval, scoring, serving, sources, text  # noqa: F401
from scholia_spark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "q5_hybrid_search"

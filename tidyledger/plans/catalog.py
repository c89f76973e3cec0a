"""All registered queries with their oracle SQL."""

from __future__ import annotations

from tidyledger.plans import (
    checks_analytics, checks_cleaning, checks_names, checks_pipeline, checks_sources, checks_text, queries_analytics,
    queries_cleaning, queries_names, queries_pipeline, queries_sources, queries_text)

QUERIES = {
    **queries_cleaning.QUERIES, **queries_analytics.QUERIES, **queries_names.QUERIES, **queries_sources.QUERIES,
    **queries_text.QUERIES, **queries_pipeline.QUERIES}
ORACLES = {
    **checks_cleaning.SQL, **checks_analytics.SQL, **checks_names.SQL, **checks_sources.SQL, **checks_text.SQL,
    **checks_pipeline.SQL}


def flagship(spark, sf_dir):
    """Clean and validate the dirty invoices, then aggregate the valid ones by segment."""
    return queries_cleaning.flagship(spark, sf_dir)

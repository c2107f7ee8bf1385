"""The query catalogue: every registered (spark, sf_dir) -> DataFrame builder
and its DuckDB oracle SQL.  Importing the ``q_*`` modules registers them."""

from __future__ import annotations

from stayline.plans import q_clinical, q_eval, q_joins, q_panel, q_quality, q_series, q_stays  # noqa: F401
from stayline.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)

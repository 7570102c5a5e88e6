"""Queries of the triage operators by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnowry.plans import columns, history, landed, responses, runs, similar, sinks  # noqa: F401  registers their queries
from winnowry.plans.queries import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_triage"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import preparation, reference

_PARTS = (reference, preparation)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in _PARTS for k, s in p.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["run_counters"](spark, sf_dir)

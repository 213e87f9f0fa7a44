"""The core's query modules, in one list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelattice.plans import graph, pages, references, search, upkeep

_MODULES = (references, pages, search, graph, upkeep)


def modules():
    return _MODULES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir)

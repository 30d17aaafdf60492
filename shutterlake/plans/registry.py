"""All queries of the core by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shutterlake.plans import found, layers, library, placing, review, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **library.QUERIES,
    **layers.QUERIES,
    **placing.QUERIES,
    **review.QUERIES,
    "p4_found": found.p4_found,
    "p4_zones": found.p4_zones,
    "p4_hidden": found.p4_hidden,
    "p5_found": found.p5_found,
}
SQL: dict[str, str] = {**sql.SQL, **layers.SQL, **placing.SQL, **review.SQL}

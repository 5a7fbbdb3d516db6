"""All queries over the motif operators, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.plans import file_plans, motif_plans, sampler_plans, sequence_plans, stream_plans, walk_plans

PARTS = (sequence_plans, motif_plans, walk_plans, sampler_plans, file_plans, stream_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for part in PARTS for k, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, (_, s) in part.QUERIES.items() if s}

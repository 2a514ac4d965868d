"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import codec_queries, derived_queries, pixel_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to BMP files, probed, decoded, and area-averaged to 3x3."""
    return codec_queries.encode_probe_decode_scale(spark, sf_dir)


def queries() -> dict[str, Query]:
    return pixel_queries.queries() | derived_queries.queries() | codec_queries.queries()


def oracle_sql() -> dict[str, str]:
    return pixel_queries.oracle_sql() | derived_queries.oracle_sql() | codec_queries.oracle_sql()

"""Network-block tables that locate clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitledger.operators import geo

NETWORKS = "network string, country_code string, country string, city string"


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header, of ``network, country_code, country, city`` as keyed blocks."""
    reader = spark.read.schema(NETWORKS)
    table = reader.csv(path, header=True) if path.lower().endswith((".csv", ".csv.gz")) else reader.parquet(path)
    return geo.blocks_from_networks(table.select("network", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in geo.GEO)))

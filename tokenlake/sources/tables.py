"""Readers for the given Parquet tables; Catalyst prunes columns and pushes filters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, e.g. ``lineitem``; a file or a folder of files."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    if not os.path.exists(path) and os.path.isdir(os.path.join(sf_dir, name)):
        path = os.path.join(sf_dir, name)
    return spark.read.parquet(path)

"""Shared bits of the query suite."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


@cache
def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> tuple[float, ...]:
    return tuple(t(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row's vector as a literal: a point look-up with a pushed filter."""
    return list(_vector(spark, sf_dir, vec_id))

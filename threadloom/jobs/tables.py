"""The given tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversations are the sessions of one dialog."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.floor(F.col("conv_id") / 10).cast("long").alias("dialog"), (F.col("conv_id") % 10).alias("session"), "turn", F.col("role").alias("speaker"), "text")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are orders, instances parts, classes brands."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "p_brand")

"""Tab-separated tables: truth, gold pairs and pairs of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema.TRUTH)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="record_id int, duplicate_id int").where(F.col("record_id").isNotNull() & F.col("duplicate_id").isNotNull())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(first, second), each pair once; rows of another width are dropped."""
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second")).distinct()

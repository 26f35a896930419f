"""What the operators of this folder share on Spark's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators, so that it sorts before every other id and joins with itself.
NO_ID = -(2**63)
#: Fixed value: the characters that end a word.
BLANKS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_key(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NO_ID))


def from_key(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def text_of(column: str) -> Column:
    """A text column as a string; null is empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def trimmed(text: Column) -> Column:
    """text without blanks at its ends, in one pass whatever their number."""
    return F.btrim(text, F.lit(BLANKS))


def n_words(text: Column) -> Column:
    """Words of a text: null and empty texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")

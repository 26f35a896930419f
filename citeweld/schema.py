"""Schemas of raw records, bibliographic items, labelled items and truth rows."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType(), False)

#: A tag's value; continuation lines are kept apart.
FIELD = T.StructType([T.StructField("tag", T.StringType()), T.StructField("value", T.StringType()), T.StructField("more", STRINGS)])

RAW_RIS = T.StructType([T.StructField("pos", T.LongType()), T.StructField("fields", T.ArrayType(FIELD))])

ITEM = T.StructType(
    [
        T.StructField("pos", T.LongType(), False),
        T.StructField("id", T.LongType()),
        T.StructField("is_old", T.BooleanType(), False),
        T.StructField("reference_type", T.StringType()),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("authors", STRINGS, False),
        T.StructField("all_authors", STRINGS, False),
        T.StructField("titles", STRINGS, False),
        T.StructField("title", T.StringType()),
        T.StructField("journals", STRINGS, False),
        T.StructField("dois", STRINGS, False),
        T.StructField("isbns", STRINGS, False),
        T.StructField("issns", STRINGS, False),
        T.StructField("page_start", T.StringType()),
        T.StructField("pages_output", T.StringType()),
        T.StructField("several_pages", T.BooleanType(), False),
        T.StructField("is_reply", T.BooleanType(), False),
        T.StructField("is_phase", T.BooleanType(), False),
        T.StructField("is_cochrane", T.BooleanType(), False),
        T.StructField("is_trial", T.BooleanType(), False),
        T.StructField("label", T.StringType()),
    ]
)

#: Fixed value: the columns of a truth table, in the order of its file.
TRUTH_COLUMNS = "id dedupid correction validated true_pos true_neg false_pos false_neg unsolvable authors_truncated authors publ_year title_truncated title title2 volume issue pages article_number dois publ_type database number_authors".split()
_INTS = {"id", "dedupid", "correction", "publ_year", "number_authors"}
_FLAGS = {"validated", "true_pos", "true_neg", "false_pos", "false_neg", "unsolvable"}
TRUTH = T.StructType([T.StructField(c, T.IntegerType() if c in _INTS else T.BooleanType() if c in _FLAGS else T.StringType()) for c in TRUTH_COLUMNS])

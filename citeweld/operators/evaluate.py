"""Results held against a truth table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classified(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, dedupid, truth_dedupid, outcome) for the truth rows that the result has: TP, FN, TN or FP.

    result has (id, dedupid), truth (id, dedupid). A label is right if it is the record's own id or the id of a record
    of its true set.
    """
    t = truth.select("id", F.col("dedupid").alias("truth_dedupid"))
    sets = truth.where("dedupid IS NOT NULL").select(F.col("dedupid").alias("truth_dedupid"), F.col("id").alias("dedupid")).distinct().withColumn("_right", F.lit(True))
    met = t.join(result.select("id", "dedupid"), "id").join(sets, ["truth_dedupid", "dedupid"], "left")
    alone = F.col("truth_dedupid").isNull() | (F.col("truth_dedupid") == F.col("id"))
    outcome = F.when(F.col("dedupid").isNull(), F.when(alone, "TN").otherwise("FN")).when(F.coalesce("_right", F.lit(False)) | (F.col("id") == F.col("dedupid")), "TP").otherwise("FP")
    return met.select("id", "dedupid", "truth_dedupid", outcome.alias("outcome"))


def metrics(outcomes: DataFrame) -> DataFrame:
    """One row of counts and rates; a rate without cases is null."""
    count = lambda x: F.coalesce(F.sum((F.col("outcome") == x).cast("long")), F.lit(0)).alias(x.lower())
    unique = F.coalesce(F.sum(((F.col("outcome") == "TP") & (F.col("id") == F.col("dedupid"))).cast("long")), F.lit(0)).alias("unique_duplicates")
    c = outcomes.agg(count("TP"), count("FN"), count("TN"), count("FP"), unique)
    rate = lambda n, d: F.try_divide(n.cast("double"), d.cast("double"))
    tp, fn, tn, fp = (F.col(x) for x in ("tp", "fn", "tn", "fp"))
    return c.select("*", rate(tp, tp + fn).alias("sensitivity"), rate(tn, tn + fp).alias("specificity"), rate(tp, tp + fp).alias("precision"), rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + fn, tp + tn + fp + fn).alias("duplicates"))


def without_kept(counted: DataFrame) -> DataFrame:
    """Counts under the convention that a set's kept record is a true negative."""
    u = F.col("unique_duplicates")
    return counted.select((F.col("tp") - u).alias("tp"), "fn", (F.col("tn") + u).alias("tn"), "fp")


def _moved(pairs: DataFrame) -> DataFrame:
    """(id, duplicate_id): ids are moved to start at 1."""
    low = pairs.agg(F.min("record_id").alias("_low"))
    return pairs.crossJoin(F.broadcast(low)).select((F.col("record_id") - F.col("_low") + 1).alias("id"), "duplicate_id")  # one row


def gold_sets(pairs: DataFrame) -> DataFrame:
    """(id, set) from (record_id, duplicate_id): ids are moved to start at 1, sets are the ids under one duplicate id."""
    moved = _moved(pairs)
    sets = moved.groupBy("duplicate_id").agg(F.array_sort(F.collect_set("id")).alias("set"))
    return moved.join(sets, "duplicate_id").select("id", "set")


def gold_alone(pairs: DataFrame) -> DataFrame:
    """(id, alone) from the same pairs: whether the id's set has no other id. Sets are never gathered: their ends tell it."""
    moved = _moved(pairs)
    ends = moved.groupBy("duplicate_id").agg((F.min("id") == F.max("id")).alias("alone"))
    return moved.join(ends, "duplicate_id").select("id", "alone")


def prefilled(items: DataFrame, gold: DataFrame) -> DataFrame:
    """First guesses of a truth table from gold (id, alone): alone TN or FP, else FN or TP, by whether the run gave a label."""
    return items.join(gold, "id").select("id", "label", F.when(F.col("alone"), F.when(F.col("label").isNull(), "TN").otherwise("FP")).otherwise(F.when(F.col("label").isNull(), "FN").otherwise("TP")).alias("outcome"))


def wrong_pairs(outcomes: DataFrame) -> DataFrame:
    """(outcome, first, second): pairs that were missed or joined wrongly, the smaller id first."""
    other = F.when(F.col("outcome") == "FN", F.col("truth_dedupid")).otherwise(F.col("dedupid"))
    return outcomes.where("outcome IN ('FN', 'FP')").withColumn("_o", other).where(F.col("_o").isNotNull() & (F.col("_o") != F.col("id"))).select("outcome", F.least("id", "_o").alias("first"), F.greatest("id", "_o").alias("second"))


def differing_pairs(truth: DataFrame, column: str) -> DataFrame:
    """(first, second): the distinct pairs of different values of a column within the true sets, that of the smaller id first."""
    side = lambda n: truth.select(F.col("dedupid"), F.col("id").alias(f"id_{n}"), F.col(column).alias(n))
    met = side("first").where("dedupid IS NOT NULL").join(side("second"), "dedupid")
    return met.where("id_first < id_second AND first != second").select("first", "second").distinct()


def analysis(outcomes: DataFrame, items: DataFrame) -> DataFrame:
    """What each test says of every pair that was missed or joined wrongly: the columns of ``explained`` with outcome and ids."""
    from .predicates import explained

    place = lambda n: items.select(F.col("id").alias(n), F.col("pos").alias(f"pos_{n}"))
    wrong = wrong_pairs(outcomes).join(place("first"), "first").join(place("second"), "second")
    pairs = wrong.select("outcome", "first", "second", F.least("pos_first", "pos_second").alias("a"), F.greatest("pos_first", "pos_second").alias("b"))
    return pairs.join(explained(items, pairs.select("a", "b").distinct()), ["a", "b"]).drop("a", "b")


def nearest_rank(df: DataFrame, group: str, value: str, percents: tuple[float, ...]) -> DataFrame:
    """Percentiles of a column by group: the least value that so many percent of the values do not exceed."""
    return df.groupBy(group).agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{p:g}") for p in percents])


def most_frequent(df: DataFrame, column: str, n: int = 500) -> DataFrame:
    """The n most frequent values and their counts; of equally frequent ones those that come first in their order."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)

"""RIS and table output."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import Mode

_TEXT = "map<string,string>"


def output_name(path: str, mode: Mode) -> str:
    """x.ris becomes x_mark.ris or x_deduplicated.ris."""
    p = PurePosixPath(path)
    return path[: len(path) - len(p.suffix)] + mode.suffix + p.suffix if p.suffix else path + mode.suffix


def tag_map(records: DataFrame) -> DataFrame:
    """(pos, tags): text of each tag; repeated tags and continuation lines become lines of it, as they are written."""
    line = lambda f: F.array_join(F.concat(F.array(f["value"]), f["more"]), "\n")
    tags = F.array_distinct(F.transform("fields", lambda f: f["tag"]))

    def text(tag: Column) -> Column:
        own = F.filter("fields", lambda f: f["tag"] == tag)
        return F.array_join(F.transform(own, lambda f, i: F.when(i == 0, line(f)).otherwise(F.concat(tag, F.lit("  - "), line(f)))), "\n")

    return records.select("pos", F.map_from_arrays(tags, F.transform(tags, text)).alias("tags"))


def serialised(tags: Column, skip: tuple[str, ...] = ()) -> Column:
    """A record's lines: TY, the other tags by alphabet, ID, ER and an empty line."""
    plain = F.array_sort(F.filter(F.map_keys(tags), lambda k: ~k.isin("TY", "ID", "ER", *skip)))
    own = lambda k: F.concat(k, F.lit("  - "), F.element_at(tags, k))
    fixed = lambda k: F.concat(F.lit(f"{k}  - "), F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))
    return F.array_join(F.concat(F.array(fixed("TY")), F.transform(plain, own), F.array(fixed("ID"), F.lit("ER  - "), F.lit(""))), "\n")


def _put(tags: Column, key: str, value: Column, when: Column) -> Column:
    """tags with key set to value where the condition holds and there is a value."""
    without = F.map_filter(tags, lambda k, _: k != key)
    return F.when(when & value.isNotNull(), F.map_concat(without, F.create_map(F.lit(key), value))).otherwise(tags)


def _drop(tags: Column, key: str, when: Column) -> Column:
    return F.when(when, F.map_filter(tags, lambda k, _: k != key)).otherwise(tags)


def completed(df: DataFrame) -> DataFrame:
    """df (tags and the columns of an item) with the item's values in its tags."""
    have = lambda k: F.map_contains_key("tags", F.lit(k))
    value = lambda k: F.try_element_at("tags", F.lit(k))
    t = F.col("tags")
    step = lambda df, c: df.withColumn("tags", c)
    df = step(df, _put(t, "DO", F.array_join(F.transform("dois", lambda d: F.concat(F.lit("https://doi.org/"), d)), "\n"), F.size("dois") > 0))
    df = step(df, _drop(t, "SP", F.coalesce(F.col("pages_output") == "", F.lit(True))))
    df = step(df, _put(t, "SP", F.col("pages_output"), F.col("pages_output") != ""))
    for k in ("TI", "ST"):
        df = step(df, _put(t, k, F.col("title"), F.col("is_reply") | F.col("title").isNotNull()))
    study = F.concat(F.lit("https://clinicaltrials.gov/study/"), F.coalesce("page_start", F.lit("null")))
    others = F.filter(F.transform(F.split(F.coalesce(value("UR"), F.lit("")), "\n"), lambda u: F.regexp_replace(u, "UR  - ", "")), lambda u: (u != "") & ~u.startswith("https://clinicaltrials.gov"))
    df = step(df, _put(t, "UR", F.array_join(F.concat(F.array(study), others), "\nUR  - "), F.col("is_trial")))
    df = step(df, _put(t, "TY", F.lit("JOUR"), F.col("is_trial")))
    df = step(df, _put(t, "T2", F.lit("https://clinicaltrials.gov"), F.col("is_trial")))
    df = step(df, _drop(t, "AU", F.coalesce((F.size("authors") == 0) & value("AU").isin("Anonymous", "Nct"), F.lit(False))))
    df = step(df, _put(t, "PY", F.col("year").cast("string"), ~have("PY") & (F.col("year") != 0)))
    ssrn = F.when(F.contains(value("DO"), F.lit("https://doi.org/10.2139/ssrn")), F.lit("Social Science Research Network"))
    return step(df, _put(t, "T2", F.coalesce(value("J2"), ssrn), ~have("T2")))


def ris_lines(records: DataFrame, items: DataFrame, mode: Mode) -> DataFrame:
    """(pos, value): the text of each record to write."""
    joined = tag_map(records).join(items, "pos")
    joined = joined.withColumn("tags", _put(F.col("tags"), "ID", F.col("id").cast("string"), F.lit(True)))
    if mode is Mode.MARK:
        marked = _put(F.map_filter("tags", lambda k, _: k != "LB"), "LB", F.col("label"), F.col("label").isNotNull())
        return joined.select("pos", serialised(marked).alias("value"))
    return completed(joined.where("kept")).select("pos", serialised(F.col("tags"), ("C7",)).alias("value"))


def write_ris(lines: DataFrame, path: str, one_file: bool = True) -> None:
    """Writes the records in order. With one_file all of them go through one task, as one RIS file needs; else to a folder of
    files whose names keep the order."""
    ordered = lines.repartition(1).sortWithinPartitions("pos") if one_file else lines.orderBy("pos")
    ordered.select("value").write.mode("overwrite").text(path)


def truth_lines(records: DataFrame, truth: DataFrame, by_validation: bool = False) -> DataFrame:
    """Records with the truth in CA (Duplicate, Unknown or -) and its id in LB; by_validation: in capitals if validated."""
    t = truth.select(F.col("id").alias("_id"), "dedupid", "validated")
    word = F.when(F.col("_id").isNull() | ~F.coalesce("validated", F.lit(False)), "Unknown").when(F.col("dedupid").isNotNull(), "Duplicate").otherwise("-")
    if by_validation:
        word = F.when(F.coalesce("validated", F.lit(False)), F.upper(F.when(F.col("dedupid").isNotNull(), "Duplicate").otherwise("-"))).otherwise(F.lower(F.when(F.col("dedupid").isNotNull(), F.lit("Duplicate")).otherwise("Unknown")))
    m = tag_map(records).withColumn("_own", F.coalesce(F.try_element_at("tags", F.lit("ID")).cast("int"), F.col("pos").cast("int")))
    joined = m.join(t, F.col("_own") == F.col("_id"), "left")
    tags = _put(_put(F.map_filter("tags", lambda k, _: k != "LB"), "CA", word, F.lit(True)), "LB", F.col("dedupid").cast("string"), F.col("dedupid").isNotNull())
    return joined.select("pos", serialised(tags).alias("value"))


def truth_rows(records: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of a truth table from records and their labelled items."""
    m = tag_map(records).join(items.select("pos", "id", "label", "year", "dois", "authors"), "pos")
    value = lambda k: F.try_element_at("tags", F.lit(k))
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema.TRUTH.fields}
    authors = F.regexp_replace(value("AU"), "\nAU  - ", "; ")
    found = {
        "id": F.col("id").cast("int"), "dedupid": F.col("label").cast("int"), "validated": F.lit(False), "true_pos": F.lit(False), "true_neg": F.lit(False), "false_pos": F.lit(False), "false_neg": F.lit(False), "unsolvable": F.lit(False),
        "authors_truncated": F.substring(authors, 1, 254), "authors": authors, "publ_year": F.col("year"), "title_truncated": F.substring(value("TI"), 1, 254), "title": value("TI"), "title2": F.substring(value("T2"), 1, 254), "volume": value("VL"), "issue": value("IS"),
        "pages": value("SP"), "article_number": value("C7"), "dois": F.array_join("dois", "; "), "publ_type": value("TY"), "database": value("DP"), "number_authors": F.size("authors"),
    }
    return m.select(*[found.get(c, none[c]).alias(c) for c in schema.TRUTH_COLUMNS])


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)

"""The queries of the record-linkage engine over the driver's tables, each with DuckDB's SQL where SQL can state it.

The tables hold no bibliography, so each operator works on the column that comes closest to its field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Mode
from ..functions import normal
from ..functions.columns import lifted
from ..functions.similarity import jaro_winkler
from ..operators import evaluate, predicates
from ..operators.enrich import cumulative_percent, enriched
from ..sources import ris, tables, writers
from ..spark import cut, remove, shared_folder
from . import matching, reading
from .registry import ORACLES, QUERIES, query, t

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "linkage_documents"


# fields


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_extract(spark, d):
    return t(spark, d, "orders").groupBy(lifted(normal.year, "int")(F.col("o_orderdate").cast("string")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {reading.latin('text')} AS text FROM documents")
def basic_latin_fold(spark, d):
    return t(spark, d, "documents").select("doc_id", lifted(normal.basic_latin, "string")(F.col("text")).alias("text"))


@query("SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey)[1:40], '; ') AS authors FROM orders GROUP BY o_custkey")
def authors_joined(spark, d):
    first = lifted(lambda names: normal.all_authors([(str(n), str(n), False) for n in names])[0], "string")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("_k")).select("o_custkey", first(F.col("_k")).alias("authors"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS value FROM part")
def roman_to_int(spark, d):
    tens = F.array(*map(F.lit, ("", "X", "XX", "XXX", "XL", "L")))
    ones = F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    text = F.lower(F.concat(F.get(tens, F.expr("int(p_size div 10)")), F.get(ones, F.col("p_size") % 10)))
    return t(spark, d, "part").select("p_partkey", lifted(normal.roman, "int")(text).alias("value"))


_REVERSED = reading.lines("'TY  - JOUR'", "'TI  - ' || n_name", "CASE WHEN n_nationkey % 2 = 0 THEN 'SP  - 10-19' ELSE 'SP  - 10' END", "'ID  - ' || CAST(n_nationkey AS STRING)")


@query(f"SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN {reading.title_sql('n_name')} || '|' || reverse({reading.title_sql('n_name')}) ELSE {reading.title_sql('n_name')} END AS titles FROM nation")
def reversed_titles(spark, d):
    """Works of several pages are compared by their titles read backwards too."""
    return ris.items(reading.through_ris(spark, d, "nation", "n_nationkey", _REVERSED)).select("id", F.array_join("titles", "|").alias("titles"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cd' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END AS page FROM orders")
def cochrane_page(spark, d):
    """The number of a review within its DOI."""
    doi = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1002/14651858.cd"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".pub2"))).otherwise(F.lit("10.1234/x"))
    return t(spark, d, "orders").select("o_orderkey", lifted(normal.cochrane_page, "string")(F.array(doi)).alias("page"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '&lt;', '<'), '&eacute;', 'é'), '&#65;', 'A')) AS text FROM (SELECT doc_id, '&lt;b' || replace(text, '&', ' ') || '&eacute;&#65;&nosuch;' AS text FROM documents)")
def html_unescape(spark, d):
    raw = F.concat(F.lit("&lt;b"), F.replace("text", F.lit("&"), F.lit(" ")), F.lit("&eacute;&#65;&nosuch;"))
    return t(spark, d, "documents").select("doc_id", F.md5(F.encode(lifted(normal.unescape, "string")(raw), "UTF-8")).alias("text"))


# comparison


# matches as places in the longer name: the first free one within reach; half transpositions are not rounded
_JARO = """WITH p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 5),
o AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM p),
r AS (SELECT *, greatest(length(l) // 2 - 1, 0) AS reach FROM o),
m AS (SELECT *, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, length(s) + 1), lambda i: [i])), lambda u, i: list_append(u, coalesce(list_filter(range(greatest(1, i[1] - reach), least(length(l), i[1] + reach) + 1), lambda q: l[q] = s[i[1]] AND NOT list_contains(u, q))[1], 0))) AS hits FROM r),
k AS (SELECT *, list_filter(range(1, length(s) + 1), lambda i: hits[i] > 0) AS own, list_sort(list_filter(hits, lambda q: q > 0)) AS other FROM m),
j AS (SELECT *, len(own) AS n, len(list_filter(range(1, len(own) + 1), lambda i: s[own[i]] <> l[other[i]])) / 2 AS moved, CASE WHEN x[1] <> y[1] THEN 0 WHEN x[2] <> y[2] THEN 1 WHEN x[3] <> y[3] THEN 2 WHEN x[4] <> y[4] THEN 3 ELSE 4 END AS same FROM k),
v AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (n / length(x) + n / length(y) + (n - moved) / n) / 3 END AS jaro FROM j),
w AS (SELECT p_partkey, x, y, CASE WHEN x = y THEN 1 WHEN jaro < 0.7 THEN jaro ELSE jaro + 0.1 * same * (1 - jaro) END AS similarity FROM v)"""


@query(_JARO + " SELECT p_partkey, round(similarity, 6) AS similarity FROM w")
def jaro_winkler_names(spark, d):
    a, b = t(spark, d, "part"), t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("other"))
    alike = lifted(jaro_winkler, "double")(F.col("p_name"), F.col("other"))
    return a.withColumn("k", F.col("p_partkey") - F.col("p_partkey") % 5).join(b, "k").select("p_partkey", F.round(alike, 6).alias("similarity"))


@query(_JARO + " SELECT p_partkey // 5 AS k, round(max(similarity), 6) AS similarity FROM w GROUP BY 1")
def highest_similarity(spark, d):
    """The most alike of all pairs of strings of two lists, as authors and titles are compared."""
    part = t(spark, d, "part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / 5).alias("k"))
    heads = part.where("p_partkey % 5 = 0").select("k", F.array("p_name").alias("head"))
    lists = part.groupBy("k").agg(F.collect_list("p_name").alias("names")).join(heads, "k")
    best = lifted(lambda p, q: float(predicates.best([p], [q])[0]), "double")
    return lists.select("k", F.round(best(F.col("head"), F.col("names")), 6).alias("similarity"))


_SPELLED = "SELECT a.p_partkey, a.p_name AS x, b.p_name AS y, a.p_type AS u, b.p_type AS v FROM part a JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 3"
_WORD = "(?i)\\b"


@query(
    f"""WITH j AS ({_SPELLED}), s AS (SELECT *, array_to_string(list_transform(string_split(x, ' '), lambda w: w[1:3]), ' ') AS short, array_to_string(list_transform(string_split(upper(u), ' '), lambda w: w[1]), '') AS ini FROM j)
SELECT p_partkey, regexp_matches(y, '{_WORD}' || replace(short, ' ', '.*\\b') || '.*') AS abbreviated, regexp_matches(v, '{_WORD}' || array_to_string(string_split(ini, ''), '.*\\b') || '.*') AS initials, regexp_matches(v, '{_WORD}' || array_to_string(string_split(ini, ''), '.*\\b') || '.*') AND length(ini) > 2 OR (length(ini) < 6 AND regexp_matches(v, '{_WORD}' || array_to_string(string_split(ini, ''), '.*\\b') || '.*')) AS starts FROM s"""
)
def journal_spellings(spark, d):
    """Journals by abbreviated words, by initials, and by initials at the start of the name."""
    part = t(spark, d, "part")
    other = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("y"), F.col("p_type").alias("v"))
    short = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 3)), " ")
    initials = F.array_join(F.transform(F.split(F.upper("p_type"), " "), lambda w: F.substring(w, 1, 1)), "")
    tests = {"abbreviated": (predicates.abbreviates, short, "y"), "initials": (predicates.initials_of, initials, "v"), "starts": (predicates.starts_as_initials, initials, "v")}
    return part.withColumn("k", F.col("p_partkey") - F.col("p_partkey") % 3).join(other, "k").select("p_partkey", *[lifted(f, "boolean")(x, F.col(y)).alias(n) for n, (f, x, y) in tests.items()])


@query("SELECT min(doc_id) AS first, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicate_sets(spark, d):
    return t(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).where("n > 1").drop("k")


@query("SELECT doc_id, CAST(min(doc_id) OVER (PARTITION BY md5(text)) AS BIGINT) AS label FROM documents")
def mark_all(spark, d):
    """Every row with its set's first id; sets are reduced first and joined, so a large set is never one task's window."""
    docs = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return docs.join(docs.groupBy("k").agg(F.min("doc_id").alias("label")), "k").select("doc_id", "label")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items with their customer as label."""
    none = matching.blank()
    found = {
        "pos": F.col("o_orderkey"), "id": F.col("o_orderkey"), "label": F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")), "is_reply": F.col("o_orderkey") % 2 == 0, "is_trial": F.col("o_orderkey") % 11 == 0,
        "year": F.when(F.col("o_orderkey") % 4 == 0, F.lit(0)).otherwise(F.year("o_orderdate")), "title": F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"))), "dois": F.array("o_orderpriority"),
        "pages_output": F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))), "is_cochrane": F.col("o_orderkey") % 13 == 0,
    }
    return t(spark, d, "orders").select(*[found.get(c, none[c]).alias(c) for c in none])


_SETS = """WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS label, o_orderkey % 2 = 0 AS reply, o_orderkey % 11 = 0 AS trial, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(year(o_orderdate) AS INTEGER) END AS y,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ' ' || o_orderkey END AS title, o_orderpriority AS doi, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE 'p' || o_orderkey END AS pages, o_orderkey % 13 = 0 AS coch FROM orders),
f AS (SELECT *, CASE WHEN label IS NULL THEN true ELSE id = min(id) OVER (PARTITION BY label) END AS kept FROM i),
g AS (SELECT label, arg_max(title, (length(title), -id)) AS longest, arg_min(title, (length(title), id)) AS shortest, list(doi ORDER BY id) AS dois, arg_min(y, id) FILTER (y <> 0) AS yy, arg_min(pages, id) FILTER (pages IS NOT NULL) AS pp FROM f WHERE label IS NOT NULL AND NOT kept GROUP BY label)"""


@query(
    _SETS
    + """ SELECT id, kept, CASE WHEN f.label IS NOT NULL AND kept AND trial THEN CASE WHEN title IS NULL OR length(title) > length(shortest) THEN coalesce(shortest, title) ELSE title END
WHEN f.label IS NOT NULL AND kept AND (reply OR title IS NOT NULL) THEN CASE WHEN title IS NULL OR length(title) < length(longest) THEN coalesce(longest, title) ELSE title END ELSE title END AS title,
CASE WHEN f.label IS NOT NULL AND kept AND y = 0 THEN coalesce(yy, 0) ELSE y END AS year FROM f LEFT JOIN g ON f.label = g.label"""
)
def enrich_titles_years(spark, d):
    return enriched(_sets(spark, d)).select("id", "kept", "title", "year")


@query(
    _SETS
    + """, h AS (SELECT f.*, g.dois, g.pp, CASE WHEN coch AND (kept OR f.label IS NULL) THEN upper(pages) ELSE pages END AS own FROM f LEFT JOIN g ON f.label = g.label)
SELECT id, CASE WHEN label IS NOT NULL AND kept AND (own IS NULL OR own = '') THEN coalesce(pp, own) ELSE own END AS pages_output, CASE WHEN label IS NOT NULL AND kept THEN array_to_string(list_sort(list_distinct(list_prepend(doi, coalesce(dois, [])))), '|') ELSE doi END AS dois FROM h"""
)
def enrich_pages_dois(spark, d):
    return enriched(_sets(spark, d)).select("id", "pages_output", F.array_join(F.array_sort("dois"), "|").alias("dois"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(_SETS + " SELECT count(*) AS total, count(label) AS labelled, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS written FROM f")
def counts_report(spark, d):
    return enriched(_sets(spark, d)).agg(F.count(F.lit(1)).alias("total"), F.count("label").alias("labelled"), F.sum(F.col("kept").cast("long")).alias("written"))


@query("SELECT y AS year, CAST(floor(sum(n) OVER (ORDER BY y DESC) * 100 / sum(n) OVER ()) AS INTEGER) AS percent FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1)")
def cumulative_percentages(spark, d):
    return cumulative_percent(t(spark, d, "orders").select(F.year("o_orderdate").alias("year")))


@query("SELECT s_suppkey, 'TY  - JOUR' || chr(10) || 'AU  - ' || s_name || chr(10) || 'PY  - ' || (1900 + s_nationkey) || chr(10) || 'T2  - ' || n_name || chr(10) || 'ID  - ' || s_suppkey || chr(10) || 'ER  - ' || chr(10) AS record FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ris_serialise(spark, d):
    both = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tags = F.create_map(F.lit("T2"), F.col("n_name"), F.lit("ID"), F.col("s_suppkey").cast("string"), F.lit("PY"), (F.lit(1900) + F.col("s_nationkey")).cast("string"), F.lit("AU"), F.col("s_name"), F.lit("TY"), F.lit("JOUR"))
    return both.select("s_suppkey", writers.serialised(tags).alias("record"))


# evaluation


def _judged(spark: SparkSession, d: str) -> DataFrame:
    labels = t(spark, d, "labels")
    result = labels.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") - F.col("doc_id") % 9).alias("dedupid"))
    truth = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.col("doc_id") - F.col("doc_id") % 7).alias("dedupid"))
    return evaluate.classified(result, truth)


_JUDGED = """WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id - doc_id % 9 END AS v, CASE WHEN quality = 1 THEN doc_id - doc_id % 7 END AS t FROM labels),
o AS (SELECT id, v, t, CASE WHEN v IS NULL THEN CASE WHEN t IS NULL OR t = id THEN 'TN' ELSE 'FN' END WHEN id = v OR EXISTS (SELECT 1 FROM r s WHERE s.t = r.t AND s.id = r.v) THEN 'TP' ELSE 'FP' END AS outcome FROM r)"""


@query(_JUDGED + " SELECT id, v AS dedupid, t AS truth_dedupid, outcome FROM o")
def confusion_classes(spark, d):
    return _judged(spark, d)


@query(
    _JUDGED
    + """, c AS (SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TP' AND id = v) AS unique_duplicates FROM o)
SELECT *, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fp), 9) AS precision, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + fn) / (tp + tn + fp + fn), 9) AS duplicates FROM c"""
)
def evaluation_metrics(spark, d):
    m = evaluate.metrics(_judged(spark, d))
    rates = {"sensitivity", "specificity", "precision", "accuracy", "f1", "duplicates"}
    return m.select(*[F.round(c, 9).alias(c) if c in rates else F.col(c) for c in m.columns])


@query(_JUDGED + " SELECT outcome, least(id, w) AS first, greatest(id, w) AS second FROM (SELECT *, CASE outcome WHEN 'FN' THEN t ELSE v END AS w FROM o WHERE outcome IN ('FN', 'FP')) WHERE w IS NOT NULL AND w <> id")
def wrong_pairs(spark, d):
    return evaluate.wrong_pairs(_judged(spark, d))


@query(_JUDGED + " SELECT count(*) FILTER (outcome = 'TP' AND id <> v) AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN' OR (outcome = 'TP' AND id = v)) AS tn, count(*) FILTER (outcome = 'FP') AS fp FROM o")
def metrics_without_kept(spark, d):
    return evaluate.without_kept(evaluate.metrics(_judged(spark, d)))


_GOLD = "WITH m AS (SELECT l_orderkey * 8 + l_linenumber AS r, l_suppkey AS k FROM lineitem), b AS (SELECT r - min(r) OVER () + 1 AS id, k FROM m), s AS (SELECT k, list_sort(list_distinct(list(id))) AS s FROM b GROUP BY k)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold pairs as a file, read back."""
    path = f"{shared_folder(spark)}/gold"
    t(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("r"), "l_suppkey").write.mode("overwrite").option("sep", "\t").csv(path)
    pairs = cut(tables.read_gold(spark, path))
    remove(spark, path)
    return pairs


@query(_GOLD + " SELECT id, len(s) AS n, md5(array_to_string(s, ',')) AS set FROM b JOIN s USING (k)")
def gold_sets(spark, d):
    found = evaluate.gold_sets(_gold(spark, d))
    return found.select("id", F.size("set").cast("long").alias("n"), F.md5(F.array_join(F.transform("set", lambda x: x.cast("string")), ",").cast("binary")).alias("set"))


@query(_GOLD + ", i AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS label FROM lineitem) SELECT i.id, label, CASE WHEN len(s) = 1 THEN CASE WHEN label IS NULL THEN 'TN' ELSE 'FP' END WHEN label IS NULL THEN 'FN' ELSE 'TP' END AS outcome FROM i JOIN b ON b.id = i.id JOIN s USING (k)")
def gold_prefill(spark, d):
    items = t(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).alias("label"))
    return evaluate.prefilled(items, evaluate.gold_alone(_gold(spark, d)))


@query("SELECT DISTINCT a.o_orderpriority AS first, b.o_orderpriority AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority")
def truth_pairs(spark, d):
    return evaluate.differing_pairs(t(spark, d, "orders").select(F.col("o_custkey").alias("dedupid"), F.col("o_orderkey").alias("id"), "o_orderpriority"), "o_orderpriority")


@query("SELECT DISTINCT c_mktsegment AS first, n_name AS second FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pair_files(spark, d):
    """Two columns of a file, each pair once; lines of another width are dropped."""
    path = f"{shared_folder(spark)}/pairs"
    both = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    both.select(F.concat_ws("\t", "c_mktsegment", "n_name").alias("value")).unionByName(both.select(F.col("c_mktsegment").alias("value"))).write.mode("overwrite").text(path)
    pairs = cut(tables.read_pairs(spark, path))
    remove(spark, path)
    return pairs


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.98) AS p98, quantile_disc(l_extendedprice, 0.5) AS p50 FROM lineitem GROUP BY l_returnflag")
def percentile_rank(spark, d):
    return evaluate.nearest_rank(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", (98, 50))


@query(f"SELECT title, n FROM (SELECT {reading.title_sql('text')} AS title, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, title LIMIT 500")
def top_titles(spark, d):
    """The 500 most frequent titles: a limit that is the feature."""
    return evaluate.most_frequent(t(spark, d, "documents").select(matching.title(F.coalesce("text", F.lit(""))).alias("title")), "title")


# files that are written

_RECORD = reading.lines("'TY  - JOUR'", "'AU  - ' || s_name", "'AU  - Doe, J'", "'TI  - Work ' || CAST(s_suppkey AS STRING)", "'PY  - ' || CAST(1900 + s_nationkey AS STRING)", "'SP  - 12-4'", "'C7  - e9'", "'LB  - old'", "'DO  - 10.1234/' || CAST(s_suppkey AS STRING)", "'ID  - ' || CAST(s_suppkey AS STRING)")
_HEAD = "'TY  - JOUR' || chr(10) || 'AU  - ' || s_name || chr(10) || 'AU  - Doe, J' || chr(10)"
_TAIL = "'ID  - ' || s_suppkey || chr(10) || 'ER  - ' || chr(10)"


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = reading.through_ris(spark, d, "supplier", "s_suppkey", _RECORD)
    return records, cut(ris.items(records).withColumn("label", F.when(F.col("id") % 4 > 0, (F.col("id") - F.col("id") % 4).cast("string"))))


@query(f"SELECT {_HEAD} || 'C7  - e9' || chr(10) || 'DO  - 10.1234/' || s_suppkey || chr(10) || CASE WHEN s_suppkey % 4 > 0 THEN 'LB  - ' || (s_suppkey - s_suppkey % 4) || chr(10) ELSE '' END || 'PY  - ' || (1900 + s_nationkey) || chr(10) || 'SP  - 12-4' || chr(10) || 'TI  - Work ' || s_suppkey || chr(10) || {_TAIL} AS value FROM supplier")
def marked_file(spark, d):
    """Every record with its label in place of the one that it had."""
    return writers.ris_lines(*_labelled(spark, d), Mode.MARK).select("value")


@query(
    f"""WITH s AS (SELECT *, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey - s_suppkey % 4 END AS label FROM supplier),
k AS (SELECT *, label IS NULL OR s_suppkey = min(s_suppkey) OVER (PARTITION BY label) AS kept, string_agg('https://doi.org/10.1234/' || s_suppkey, chr(10)) OVER (PARTITION BY label ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dois FROM s)
SELECT {_HEAD} || 'DO  - ' || CASE WHEN label IS NULL THEN 'https://doi.org/10.1234/' || s_suppkey ELSE dois END || chr(10) || 'LB  - old' || chr(10) || 'PY  - ' || (1900 + s_nationkey) || chr(10) || 'SP  - 12-4' || chr(10) || 'TI  - Work ' || s_suppkey || chr(10) || {_TAIL} AS value FROM k WHERE kept"""
)
def deduplicated_file(spark, d):
    """One record for each set, with the DOIs of all; a range of pages goes before an article number."""
    records, items = _labelled(spark, d)
    return writers.ris_lines(records, enriched(items), Mode.REMOVE).select("value")


@query("SELECT CAST(s_suppkey AS INTEGER) AS id, CAST(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey - s_suppkey % 4 END AS INTEGER) AS dedupid, s_name || '; Doe, J' AS authors, CAST(CASE WHEN 1900 + s_nationkey < 1850 THEN 0 ELSE 1900 + s_nationkey END AS INTEGER) AS publ_year, 'Work ' || s_suppkey AS title, '12-4' AS pages, 'e9' AS article_number, '10.1234/' || s_suppkey AS dois, 2 AS number_authors, false AS validated FROM supplier")
def truth_table_file(spark, d):
    """A truth table of labelled records, written and read back."""
    path = f"{shared_folder(spark)}/truth"
    writers.write_table(writers.truth_rows(*_labelled(spark, d)), path)
    rows = cut(tables.read_truth(spark, path))
    remove(spark, path)
    return rows.select("id", "dedupid", "authors", "publ_year", "title", "pages", "article_number", "dois", "number_authors", "validated")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").cast("int").alias("id"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") - F.col("s_suppkey") % 4).cast("int").alias("dedupid"), (F.col("s_suppkey") % 3 > 0).alias("validated"))


_TRUTH_LINES = f"SELECT {_HEAD} || 'C7  - e9' || chr(10) || 'CA  - ' || {{0}} || chr(10) || 'DO  - 10.1234/' || s_suppkey || chr(10) || CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 4 > 0 THEN 'LB  - ' || (s_suppkey - s_suppkey % 4) || chr(10) ELSE '' END || 'PY  - ' || (1900 + s_nationkey) || chr(10) || 'SP  - 12-4' || chr(10) || 'TI  - Work ' || s_suppkey || chr(10) || {_TAIL} AS value FROM supplier"


@query(_TRUTH_LINES.format("CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 'Unknown' WHEN s_suppkey % 4 > 0 THEN 'Duplicate' ELSE '-' END"))
def truth_file(spark, d):
    return writers.truth_lines(_labelled(spark, d)[0], _truth(spark, d)).select("value")


@query(_TRUTH_LINES.format("CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 THEN CASE WHEN s_suppkey % 4 > 0 THEN 'DUPLICATE' ELSE '-' END WHEN s_suppkey % 5 > 0 AND s_suppkey % 4 > 0 THEN 'duplicate' ELSE 'unknown' END"))
def truth_file_by_validation(spark, d):
    return writers.truth_lines(_labelled(spark, d)[0], _truth(spark, d), by_validation=True).select("value")


@query(
    _JUDGED
    + f""", w AS (SELECT outcome, least(id, x) AS first, greatest(id, x) AS second FROM (SELECT *, CASE outcome WHEN 'FN' THEN t ELSE v END AS x FROM o WHERE outcome IN ('FN', 'FP')) WHERE x IS NOT NULL AND x <> id),
{matching._ITEMS}
SELECT outcome, first, second, CASE WHEN a.page_start IS NULL OR b.page_start IS NULL THEN coalesce(a.doi IS NULL OR b.doi IS NULL OR a.doi = b.doi, true) ELSE a.page_start = b.page_start END AS pages_or_dois,
CASE WHEN a.doi = b.doi THEN true WHEN a.isbn IS NOT NULL AND b.isbn IS NOT NULL THEN a.isbn = b.isbn WHEN a.issn = b.issn OR a.journal = b.journal THEN true WHEN a.journal IS NULL OR b.journal IS NULL THEN false END AS same_work FROM w JOIN i a ON a.id = first + 1 JOIN i b ON b.id = second + 1"""
)
def wrong_pairs_explained(spark, d):
    """Each pair that was missed or joined wrongly, with what the tests say of it."""
    items = cut(matching.document_items(spark, d).withColumn("id", F.col("id") - 1))
    return evaluate.analysis(_judged(spark, d), items).select("outcome", "first", "second", "pages_or_dois", "same_work")


@query("SELECT o_custkey, arg_max(o_orderpriority, (length(o_orderpriority), -o_orderkey)) AS longest, arg_min(o_orderpriority, (length(o_orderpriority), o_orderkey)) AS shortest FROM orders GROUP BY o_custkey")
def longest_and_shortest(spark, d):
    size = F.length("o_orderpriority")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct(size, -F.col("o_orderkey"))).alias("longest"), F.min_by("o_orderpriority", F.struct(size, F.col("o_orderkey"))).alias("shortest"))

"""Queries of the reader: the driver's tables are written as RIS files, read back, and held against the rules in SQL.

The text of a record is one expression that Spark and DuckDB both understand, so both sides start from the same lines.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ris, writers
from ..spark import cut, remove, shared_folder
from .registry import query, t


def through_ris(spark: SparkSession, d: str, table: str, pos: str, record: str) -> DataFrame:
    """The records of a RIS file with one record for each row of a table, in the order of pos."""
    path = f"{shared_folder(spark)}/ris-{uuid.uuid4().hex}"
    writers.write_ris(t(spark, d, table).selectExpr(f"{pos} AS pos", f"{record} AS value"), path, one_file=False)
    records = cut(ris.read_records(spark, path))
    remove(spark, path)
    return records


def lines(*fields: str) -> str:
    """A record of fields (expressions of whole lines; null: no such line)."""
    return "concat_ws(chr(10), " + ", ".join([*fields, "'ER  - '", "''"]) + ")"


# Python's, Java's and RE2's \s, \d and \b differ, so classes are written out.
SPACES = "[\\p{Zs}\\p{Zl}\\p{Zp}\\x09\\x0B\\x0C\\x0D]"


def clean(x: str) -> str:
    """A line as the reader sees it, in DuckDB's SQL."""
    return f"regexp_replace(replace(regexp_replace({x}, '\\p{{Pd}}', '-', 'g'), chr(8201), ''), '{SPACES}', ' ', 'g')"


def latin(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


ONE_LINE = "translate(text, chr(10) || chr(13), '  ')"

# records, ids and years

_YEAR_TEXT = "CASE doc_id % 6 WHEN 0 THEN CAST(1840 + doc_id % 190 AS STRING) WHEN 1 THEN '(' || CAST(1790 + doc_id % 190 AS STRING) || ') x' WHEN 2 THEN 'c' || CAST(1900 + doc_id % 120 AS STRING) || '/05//' WHEN 3 THEN '12' || CAST(1900 + doc_id % 99 AS STRING) WHEN 4 THEN 'n.d.' ELSE CAST(1900 + doc_id % 100 AS STRING) || '-' || CAST(2000 + doc_id % 20 AS STRING) END"
_IDS = lines("'TY  - ' || CASE WHEN doc_id % 2 = 0 THEN 'JOUR' ELSE 'CHAP' END", "CASE WHEN doc_id % 3 <> 0 THEN 'ID  - ' || CAST(doc_id % 3 * 1000000 + doc_id AS STRING) WHEN doc_id % 9 = 0 THEN 'ID  - NA' END", f"'PY  - ' || {_YEAR_TEXT}", f"'N2  - ' || {ONE_LINE}", "CASE WHEN doc_id % 4 = 0 THEN 'KW  - ' END", "'LB  - ' || lang")


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos, {_YEAR_TEXT} AS y FROM documents)
SELECT CAST(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 * 1000000 + doc_id ELSE pos END AS BIGINT) AS id, pos, CASE WHEN doc_id % 2 = 0 THEN 'JOUR' ELSE 'CHAP' END AS reference_type, lang AS label,
CAST(CASE WHEN CAST('0' || regexp_extract(y, '(^|[^0-9])([0-9]{{4}})([^0-9]|$)', 2) AS INTEGER) < 1850 THEN 0 ELSE CAST(regexp_extract(y, '(^|[^0-9])([0-9]{{4}})([^0-9]|$)', 2) AS INTEGER) END AS INTEGER) AS year FROM r"""
)
def read_ids_years(spark, d):
    """Records in the order of the file; those without an id get their place; years within any text."""
    return ris.items(through_ris(spark, d, "documents", "doc_id", _IDS), labels=True).select("id", "pos", "reference_type", "label", "year")


@query(
    f"""SELECT row_number() OVER (ORDER BY doc_id) AS pos, array_to_string(list_filter(['TY=' || CASE WHEN doc_id % 2 = 0 THEN 'JOUR' ELSE 'CHAP' END, CASE WHEN doc_id % 3 <> 0 THEN 'ID=' || (doc_id % 3 * 1000000 + doc_id) END, 'PY=' || {clean(_YEAR_TEXT)},
CASE WHEN trim({clean(ONE_LINE)}) NOT IN ('', 'NA') THEN 'N2=' || md5(trim({clean(ONE_LINE)})) END, 'LB=' || lang], lambda x: x IS NOT NULL), '|') AS fields FROM documents"""
)
def read_fields(spark, d):
    """Tags and values as they are read: dashes and spaces made uniform, empty values and NA skipped."""
    value = lambda f: F.concat(f["tag"], F.lit("="), F.when(f["tag"] == "N2", F.md5(f["value"].cast("binary"))).otherwise(f["value"]))
    return through_ris(spark, d, "documents", "doc_id", _IDS).select("pos", F.array_join(F.transform("fields", value), "|").alias("fields"))


# identifiers

_DOI_LINES = ["CASE WHEN page_id % 5 = 0 THEN 'DO  - ARTN e' || CAST(page_id AS STRING) ELSE 'DO  - https://doi.org/10.1234/AB-' || CAST(page_id AS STRING) || '.' END", "CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 THEN 'doi: 10.5000/x(' || CAST(page_id % 50 AS STRING) || ')y and 10.1234/ab-' || CAST(page_id AS STRING) END"]
_SN = "lpad(CAST(page_id * 7919 % 100000000 AS STRING), 8, '0')"
_SN_LINES = [f"'SN  - ' || substr({_SN}, 1, 4) || '-' || substr({_SN}, 5, 4) || ' (print) 123456'", "CASE WHEN page_id % 7 = 0 THEN 'AU  - NA' END", "CASE WHEN page_id % 2 = 0 THEN '978-0-306-' || lpad(CAST(page_id % 99999 AS STRING), 5, '0') || '-7, 0306' || lpad(CAST(page_id % 77777 AS STRING), 5, '0') || 'x' END"]
_IDENTIFIERS = lines("'TY  - JOUR'", *_DOI_LINES, *_SN_LINES)
_joined = lambda parts: "concat_ws(' ', " + ", ".join(parts) + ")"


@query(
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY page_id) AS pos, page_id, lower({_joined(_DOI_LINES)}) AS d, upper({_joined([_SN_LINES[0], _SN_LINES[2]])}) AS s FROM pages),
n AS (SELECT *, list_transform(regexp_extract_all(s, '\\b([-0-9X]{{8,17}})\\b', 1), lambda x: replace(x, '-', '')) AS ns FROM r),
f AS (SELECT *, list_transform(regexp_extract_all(d, '\\b(10\\.[0-9]{{4,9}}/[-._;()<>/:a-z0-9]+)\\b', 1), lambda x: regexp_replace(x, '\\.$', '')) AS ds FROM n)
SELECT pos, array_to_string(list_sort(list_distinct(ds)), ' ') AS dois, array_to_string(list_sort(list_distinct(list_filter(ns, lambda x: length(x) = 8))), ' ') AS issns,
array_to_string(list_sort(list_distinct(list_transform(list_filter(ns, lambda x: length(x) IN (10, 13)), lambda x: CASE WHEN length(x) = 10 THEN substr(x, 1, 9) ELSE substr(x, 4, 9) END))), ' ') AS isbns, CASE WHEN page_id % 5 = 0 AND page_id > 0 THEN CAST(page_id AS VARCHAR) END AS page_start FROM f"""
)
def read_identifiers(spark, d):
    """DOIs, ISBNs and ISSNs of fields and the lines that go on with them; an article number in the DOI field."""
    sets = [F.array_join(F.array_sort(c), " ").alias(c) for c in ("dois", "issns", "isbns")]
    return ris.items(through_ris(spark, d, "pages", "page_id", _IDENTIFIERS)).select("pos", *sets, F.nullif("page_start", F.lit("")).alias("page_start"))


# pages

_X, _Y = "CAST(l_partkey AS STRING)", "CAST(l_suppkey AS STRING)"
_KIND = "(l_orderkey + l_linenumber) % 12"
_PAGE_LINES = [
    f"CASE {_KIND} WHEN 6 THEN 'C7  - art ' || {_X} WHEN 11 THEN 'C7  - ' || {_X} END",
    f"CASE WHEN {_KIND} IN (5, 6) THEN 'SE  - ' || {_X} || '-' || {_Y} END",
    f"CASE {_KIND} WHEN 0 THEN 'SP  - ' || {_X} || '-' || {_Y} WHEN 1 THEN 'SP  - ' || {_X} WHEN 2 THEN 'SP  - ' || {_X} WHEN 3 THEN 'SP  - e' || {_X} WHEN 4 THEN 'SP  - ' || {_X} || '-' || {_Y} || '+' WHEN 7 THEN 'SP  - 1-' || {_Y} WHEN 8 THEN 'SP  - Jan ' || {_X} WHEN 9 THEN 'SP  - UNSP 00' || {_X} || '-' || {_Y} WHEN 10 THEN 'SP  - ' || {_X} || '-' || {_Y} || ', xiv; ' || {_Y} END",
    f"CASE {_KIND} WHEN 1 THEN 'EP  - ' || {_Y} END",
]
_PAGES = lines("'TY  - JOUR'", *_PAGE_LINES)


@query(
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, regexp_extract({_PAGE_LINES[0]}, '  - (.*)', 1) AS c7, regexp_extract({_PAGE_LINES[1]}, '  - (.*)', 1) AS se, regexp_extract({_PAGE_LINES[2]}, '  - (.*)', 1) || coalesce('-' || regexp_extract({_PAGE_LINES[3]}, '  - (.*)', 1), '') AS sp FROM lineitem),
m AS (SELECT *, trim(regexp_replace(coalesce(sp, se, c7), '^(UNSP|Article|ARTN)\\s*', '')) AS field, c7 IS NOT NULL AND NOT contains(c7, ' ') AS article FROM f),
v AS (SELECT *, CASE WHEN regexp_matches(field, '\\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)') THEN NULL WHEN field LIKE '%+' THEN regexp_replace(field, '[+]$', '') ELSE field END AS own FROM m),
p AS (SELECT *, list_filter(string_split_regex(own, '[+,;]\\s*'), lambda x: NOT regexp_full_match(x, '[ivxlcmIVXLCM-]+')) AS arabic, list_filter(string_split_regex(own, '[+,;]\\s*'), lambda x: regexp_full_match(x, '[ivxlcmIVXLCM-]+')) AS roman FROM v),
e AS (SELECT *, CASE WHEN contains(arabic[1], '-') THEN regexp_replace(split_part(arabic[1], '-', 1), '^(0+|N\\.PAG)', '') ELSE arabic[1] END AS s, nullif(regexp_replace(split_part(arabic[1], '-', 2), '^(0+|N\\.PAG)', ''), '') AS z, len(roman) + len(arabic) > 1 AS more FROM p),
g AS (SELECT *, CASE WHEN length(s) >= length(z) THEN substr(s, 1, length(s) - length(z)) || z ELSE z END AS full_end, coalesce(length(s) >= length(z), false) AS short FROM e),
n AS (SELECT *, nullif(ltrim(regexp_replace(s, '[^0-9]', '', 'g'), '0'), '') AS a, nullif(ltrim(regexp_replace(full_end, '[^0-9]', '', 'g'), '0'), '') AS b, regexp_matches(own, '^[eE][^-]*$') AS electronic FROM g)
SELECT l_orderkey * 8 + l_linenumber AS place, CASE WHEN own IS NULL THEN NULL WHEN a = '1' AND CAST(b AS BIGINT) >= 100 THEN b ELSE coalesce(a, b) END AS page_start,
CASE WHEN own IS NULL THEN NULL WHEN article OR electronic THEN field WHEN s = '' THEN array_to_string(list_concat(roman, [coalesce(z, '')], arabic[2:]), '; ') WHEN short OR more THEN array_to_string(list_concat(roman, [s || coalesce('-' || full_end, '')], arabic[2:]), '; ') WHEN a IS NULL AND b IS NULL THEN '' ELSE field END AS pages_output,
own IS NOT NULL AND coalesce(a, b) IS NOT NULL AND (article OR electronic OR more OR coalesce(CAST(b AS BIGINT) - CAST(a AS BIGINT) > 1, false)) AS several_pages FROM n"""
)
def read_pages(spark, d):
    """Start pages and written pages of SP, EP, SE and C7 in twelve forms: short ends, Roman parts, months, books, article numbers."""
    place = "l_orderkey * 8 + l_linenumber"
    found = ris.items(through_ris(spark, d, "lineitem", place, lines("'TY  - JOUR'", *_PAGE_LINES, f"'ID  - ' || CAST({place} AS STRING)")))
    return found.select(F.col("id").alias("place"), "page_start", "pages_output", "several_pages")


# authors

_NAMES = [
    "'van Dorn' || chr(CAST(97 + c_custkey % 26 AS INT)) || ' Meer, ' || chr(CAST(65 + c_nationkey AS INT)) || '. Jan'",
    "CASE WHEN c_custkey % 2 = 0 THEN 'SMITH JONES, ' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'rthur B.' END",
    "CASE WHEN c_custkey % 3 = 0 THEN 'Doe Jr, ' || c_mktsegment END",
    "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' Study Group' END",
    "CASE WHEN c_custkey % 7 = 0 THEN 'Müller-Łuk, Éva Q; Cher' END",
]
_AUTHORS = lines("'TY  - JOUR'", *[f"'AU  - ' || {n}" for n in _NAMES], "CASE WHEN c_custkey % 11 = 0 THEN 'AU  - Anonymous' END")


@query(
    f"""WITH n AS (SELECT c_custkey, unnest(string_split(concat_ws('; ', {', '.join(_NAMES)}), '; ')) AS x, unnest(range(1, 20)) AS i FROM customer),
k AS (SELECT c_custkey, i, {latin('x')} AS x FROM n WHERE x IS NOT NULL AND NOT regexp_matches(x, '(?i)\\b(anonymous|No authorship, indicated|consortium|et al|grp|group|nct|study)\\b')),
p AS (SELECT *, string_split_regex(x, '\\s*,\\s+') AS parts FROM k),
c AS (SELECT *, len(parts) > 1 AS named, CASE WHEN parts[1] = upper(parts[1]) THEN array_to_string(list_transform(string_split(lower(parts[1]), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE parts[1] END AS raw, regexp_replace(parts[2], '[^A-Z]', '', 'g') AS ini FROM p),
l AS (SELECT *, CASE WHEN regexp_matches(raw, '(?i)^(.+)\\b(jr|sr|1st|2nd|3rd|ii|iii)\\b(.*)$') THEN trim(trim(regexp_extract(raw, '(?i)^(.+)\\b(jr|sr|1st|2nd|3rd|ii|iii)\\b(.*)$', 1)) || ' ' || trim(regexp_extract(raw, '(?i)^(.+)\\b(jr|sr|1st|2nd|3rd|ii|iii)\\b(.*)$', 3))) ELSE raw END AS last FROM c),
a AS (SELECT *, string_split(upper(last[1]) || last[2:], ' ') AS names FROM l),
o AS (SELECT c_custkey, i, named AND len(names) > 1 AS other, CASE WHEN named THEN last || ' ' || ini ELSE x END AS author, CASE WHEN NOT named THEN 'null' WHEN len(names) > 1 THEN names[-1] || ' ' || ini || array_to_string(list_transform(names[1:-2], lambda w: w[1]), '') ELSE last || ' ' || ini END AS transposed FROM a)
SELECT c_custkey AS id, array_to_string(list(author ORDER BY i), '|') AS authors, array_to_string(list_concat([array_to_string(list(author ORDER BY i)[1:40], '; ')], CASE WHEN bool_or(other) THEN [array_to_string(list(transposed ORDER BY i)[1:40], '; ')] ELSE [] END), '|') AS all_authors FROM o GROUP BY c_custkey"""
)
def read_authors(spark, d):
    """Names as last name and initials, and with the last of several last names first; groups and the anonymous are left out."""
    found = ris.items(through_ris(spark, d, "customer", "c_custkey", _AUTHORS[: -len(", 'ER  - ', '')")] + ", 'ID  - ' || CAST(c_custkey AS STRING), 'ER  - ', '')"))
    return found.select("id", F.array_join("authors", "|").alias("authors"), F.array_join("all_authors", "|").alias("all_authors"))


# titles

_PREFIX = "CASE doc_id % 9 WHEN 0 THEN 'Retraction: ' WHEN 1 THEN 'Editorial: ' WHEN 2 THEN 'Reprint of: ' WHEN 3 THEN '12 ' WHEN 4 THEN 'Reply to: ' WHEN 5 THEN 'RETRACTED ARTICLE: ' ELSE '' END"
_SUFFIX = "CASE doc_id % 9 WHEN 0 THEN ' (a (b) c)' WHEN 6 THEN ' &lt;i&gt;x&lt;/i&gt; &eacute;' WHEN 7 THEN ' (Retracted article. See vol. 3)' WHEN 8 THEN ' [Phase 2 trial]' ELSE '' END"
# what a retraction cuts off is found by its parentheses, which are no regular language: those texts have no others
_TITLE = f"{_PREFIX} || CASE WHEN doc_id % 9 = 0 THEN translate({ONE_LINE}, '()', '  ') ELSE {ONE_LINE} END || {_SUFFIX}"
_TITLES = lines("'TY  - JOUR'", f"'TI  - ' || {_TITLE}")
_STEPS = (
    ("(\\(?(chinese|dutch|french|german|italian|japanese|polish|russian|spanish)( text)?\\)?)$", ""),
    ("(\\(author''s transl\\))$", ""),
    ("(?i)^case (reports?|series|[-0-9]+)[.:] ", ""),
    (".\\[[^\\\\]+\\]$", ""),
    ("<[^>]+>+", ""),
    ("[()]", ""),
    ("-", ""),
    ("[^a-z0-9]", " "),
)


def _title_row(x: dict) -> dict:
    """The digest of an item's titles, taken where they are made: all forms of a long text are its length squared."""
    forms = hashlib.md5()
    for i, form in enumerate(x["titles"]):
        forms.update(b"|" * (i > 0) + form.encode())
    title = x["title"]
    return {"pos": x["pos"], "forms": len(x["titles"]), "titles": forms.hexdigest(), "title": None if title is None else hashlib.md5(title.encode()).hexdigest(), "is_phase": x["is_phase"]}


def title_sql(x: str) -> str:
    """The normal form of a title."""
    s = "lower(replace(" + latin(f"regexp_replace({x}, '[^\\P{{P}})\\]]+$', '')") + ", chr(34), ''))"
    for pattern, new in _STEPS:
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace(regexp_replace(trim({s}), ' {{2,}}', ' ', 'g'), '^(the|a|an) ', ''))"


@query(
    f"""WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, trim({clean(_TITLE)}) AS raw FROM documents),
u AS (SELECT pos, raw, replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&eacute;', 'é'), '&quot;', chr(34)), '&nbsp;', chr(160)), '&amp;', '&') AS s FROM x WHERE lower(raw) NOT IN ('not available', '[not available]', 'untitled') AND NOT regexp_full_match(raw, '[-0-9]+')),
a AS (SELECT pos, raw, s AS whole, CASE WHEN regexp_full_match(s, '.+\\(Retracted [Aa]rticle.*\\)') THEN regexp_extract(s, '^(.+)\\(Retracted [Aa]rticle.*\\)$', 1) ELSE s END AS s FROM u),
b AS (SELECT pos, raw, whole, s <> whole OR regexp_full_match(s, '(?i)((retracted|removed|review|withdrawn)( article)?[.:] )(.+)') AS withdrawn, CASE WHEN regexp_full_match(s, '(?i)((retracted|removed|review|withdrawn)( article)?[.:] )(.+)') THEN regexp_extract(s, '(?i)^((retracted|removed|review|withdrawn)( article)?[.:] )(.+)$', 4) ELSE s END AS s FROM a),
c AS (SELECT * REPLACE (CASE WHEN s LIKE 'Retraction: %(a (b) c)' AND NOT contains(substr(s, 1, length(s) - 9), '(') THEN substr(s, 13, length(s) - 21) ELSE s END AS s) FROM b),
e AS (SELECT * REPLACE (CASE WHEN regexp_full_match(s, '(.+)\\(Reprinted .*') THEN regexp_extract(s, '^(.+)\\(Reprinted .*$', 1) ELSE s END AS s) FROM c),
f AS (SELECT * REPLACE (CASE WHEN regexp_full_match(s, '(?i)Reprint( of)?:(.+)') THEN regexp_extract(s, '(?i)^Reprint( of)?:(.+)$', 2) ELSE s END AS s) FROM e),
g AS (SELECT * REPLACE (replace(CASE WHEN starts_with(s, 'Editorial: ') THEN substr(s, 12) ELSE s END, '--', ': ') AS s) FROM f),
h AS (SELECT pos, CASE WHEN regexp_full_match(s, '[0-9]+.+') THEN regexp_extract(s, '^([0-9]+)(.+)$', 2) ELSE s END AS s, s AS t, withdrawn, whole, raw FROM g),
r AS (SELECT pos, 0 AS k, s AS rest, CAST(NULL AS VARCHAR) AS head FROM h UNION ALL SELECT pos, k + 1, regexp_extract(rest, '^(.{{20,}}?)[:.?;] (.{{40,}})$', 2), regexp_extract(rest, '^(.{{20,}}?)[:.?;] (.{{40,}})$', 1) FROM r WHERE regexp_matches(rest, '^.{{20,}}?[:.?;] .{{40,}}$')),
p AS (SELECT pos, -2 AS k, 0 AS o, t AS f FROM h UNION ALL SELECT pos, -1, 0, s FROM h WHERE s <> t UNION ALL SELECT pos, k, 0, CASE WHEN lower(head) LIKE '%vs' THEN head || ' ' || rest ELSE head END FROM r WHERE k > 0 UNION ALL SELECT pos, k, 1, rest FROM r WHERE k > 0 AND NOT lower(head) LIKE '%vs'),
z AS (SELECT pos, list_filter(list({title_sql("f")} ORDER BY k, o), lambda x: x <> '') AS l FROM p GROUP BY pos),
q AS (SELECT pos, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM z)
SELECT x.pos, coalesce(len(l), 0) AS forms, md5(array_to_string(coalesce(l, []), '|')) AS titles, CASE WHEN regexp_full_match(lower(x.raw), '(^C(omment|OMMENT)|^R[Ee]: .+|.*\\breply\\b.*|.*author(.+)respon.*|^response$)') OR regexp_full_match(x.raw, '(^(Correction|Corrigendum|Erratum)( to [A-Z].*| to ''.*|( to)?: .*))|(.*(Correction|Corrigendum|Erratum)$)') OR regexp_full_match(x.raw, '.+(\\(vol [0-9]+[^0-9]+[0-9]+[^0-9]+[0-9]+[^0-9]*\\))')
OR regexp_full_match(x.raw, '(e)?(Comment|COMMENT)(|s|S|ary)\\b.*|.+[cC]omment(|s|ary)( from| on| to)?:? ([A-Z''\"]|the).+|.+[Cc]omment(|s|ary)|.+COMMENT|.*[Ii]nvited [Cc]ommen.+') THEN md5(x.raw) WHEN withdrawn THEN md5(whole) END AS title, regexp_full_match(lower(x.raw), '.*phase\\s[0-9i].*') AS is_phase
FROM x LEFT JOIN q USING (pos) LEFT JOIN h USING (pos)"""
)
def read_titles(spark, d):
    """Whole texts as titles: entities, retractions, reprints, editorials, leading numbers and subtitles as forms of their own, each in
    its normal form, and the flags of replies and phases."""
    return ris.items_as(through_ris(spark, d, "documents", "doc_id", _TITLES), _title_row, "pos long, forms int, titles string, title string, is_phase boolean")


# journals and trials

_JOURNAL_LINES = [
    "'TY  - ' || CASE WHEN p_partkey % 8 = 0 THEN 'CONF' ELSE 'JOUR' END",
    "CASE WHEN p_partkey % 4 = 1 THEN 'J2  - Natl. J. ' || p_name || ' o-' || substr(p_name, 1, 1) || 'x' END",
    "CASE WHEN p_partkey % 6 = 2 THEN 'T2  - The ' || upper(p_type) || ' / ' || p_brand || ' & Co''s (' || p_name || ')' WHEN p_partkey % 6 = 3 THEN 'T2  - Paediatric-' || p_type || ': ' || p_name || ' Suppl 3' WHEN p_partkey % 6 = 4 THEN 'T2  - http://www.clinicaltrials.gov/x' WHEN p_partkey % 6 = 5 THEN 'T2  - Cochrane Database [' || p_brand || '] of ' || p_type END",
    "CASE WHEN p_partkey % 5 = 0 THEN 'T3  - ' || p_type || '. ' || p_name WHEN p_partkey % 5 = 1 THEN 'T3  - Annual Meeting of ' || p_name WHEN p_partkey % 5 = 2 THEN 'T3  - Retracted ' || p_name END",
    "CASE WHEN p_partkey % 7 = 0 THEN 'OP  - Der ' || p_name || '-Blatt' END",
    "CASE WHEN p_partkey % 3 = 0 THEN 'VL  - ' || p_name || ' volume' ELSE 'VL  - 12' END",
]
_JOURNALS = lines(*_JOURNAL_LINES, "'ID  - ' || CAST(p_partkey AS STRING)")
_ABBREVIATIONS = (("Jpn", "Japanese"), ("Dtsch", "Deutsch"), ("eneeskd", "eneeskunde"), ("heilkd", "heilkunde"), ("Kongressbd", "Kongressband"), ("(?i)Monbl\\b", "Monatsbl"), ("Natl", "National"), ("(?i)^Zbl[. ]", "Zentralbl"), ("(?i)Jbr-btr", "JBR BTR"), ("(?i)^(Rofo|Fortschritte .* Gebiet.* R.ntgenstrahlen)", "Rofo"))


def journal_sql(x: str) -> str:
    """The normal form of a journal's name; of ``o-X`` the letter is lowered one by one."""
    s = f"replace({latin(x)}, '&', ' ')"
    for pattern, new in _ABBREVIATIONS:
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        s = f"replace(replace({s}, 'o-{c}', 'o{c}'), 'o-{c.upper()}', 'o{c}')"
    for pattern, new in (("[.-]", " "), ("^(The |Le |La |Les |L''|Der |Die |Das |Il |Het )", ""), ("''s\\b", "s"), ("''", " "), ("\\([^)]+\\)$", ""), ("[()]", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    plain = f"regexp_replace(regexp_replace({s}, '[:/]\\s.*$', ''), '(?i)[^a-z0-9]', ' ', 'g')"
    return f"trim(regexp_replace(CASE WHEN lower({x}) LIKE 'http%' THEN lower({s}) ELSE {plain} END, ' {{2,}}', ' ', 'g'))"


_SEEN = [f"regexp_extract({x}, '  - (.*)', 1)" for x in _JOURNAL_LINES[1:]]


@query(
    f"""WITH f AS (SELECT p_partkey AS id, p_partkey % 8 = 0 AS conf, {', '.join(f"nullif(trim({x}), '') AS {n}" for x, n in zip(_SEEN, ("j2", "t2", "t3", "op", "vl"), strict=True))} FROM part),
s AS (SELECT id, 'J2' AS tag, j2 AS s FROM f WHERE j2 IS NOT NULL UNION ALL SELECT id, 'T2', CASE WHEN starts_with(t2, 'http') AND contains(t2, '//clinicaltrials.gov') THEN replace(t2, 'http:', 'https:') ELSE t2 END FROM f WHERE t2 IS NOT NULL
UNION ALL SELECT id, 'T3', t3 FROM f WHERE NOT starts_with(t3, 'Retract') AND NOT regexp_full_match(t3, '((^[0-9])|(.*([0-9]{{4}}|Annual|Conference|Congress|Meeting|Society|Symposium))).*') AND length(t3) > 3 UNION ALL SELECT id, 'OP', op FROM f WHERE op IS NOT NULL AND conf UNION ALL SELECT id, 'VL', t2 || '. ' || vl FROM f WHERE length(vl) > 10 AND t2 IS NOT NULL),
c AS (SELECT id, tag, CASE WHEN starts_with(s, 'http') THEN s WHEN regexp_full_match(s, '(.+?)([0-9]+|\\. Conference.*)') THEN regexp_extract(s, '^(.+?)([0-9]+|\\. Conference.*)$', 1) ELSE s END AS s FROM s),
p AS (SELECT *, CASE WHEN starts_with(s, 'http') THEN [s] ELSE string_split_regex(s, CASE WHEN tag = 'J2' THEN '[\\[\\]=|/]' ELSE '[\\[\\]=|/]|[.] ' END) END AS parts FROM c),
g AS (SELECT *, list_distinct(list_concat(parts, [s])) AS forms FROM p),
m AS (SELECT id, s, unnest(list_concat(forms, list_transform(list_filter(forms, lambda x: contains(x, ':')), lambda x: replace(x, ':', ' ')), list_transform(list_filter(forms, lambda x: contains(x, '-')), lambda x: replace(x, '-', ' ')), list_transform(list_filter(forms, lambda x: contains(x, '-')), lambda x: replace(x, '-', '')), list_transform(list_filter(forms, lambda x: contains(x, 'ae')), lambda x: replace(x, 'ae', 'e')), CASE WHEN regexp_matches(s, '(?i)(\\b(Suppl|Supplement|Supplementum)\\b.*)$') THEN [regexp_replace(s, '(?i)(\\b(Suppl|Supplement|Supplementum)\\b.*)$', '')] ELSE [] END)) AS j FROM g),
k AS (SELECT id, s, trim(j) AS j FROM m WHERE trim(j) <> '' AND lower(trim(j)) NOT IN ('electronic resource', 'et al.', 'technical report')),
n AS (SELECT id, CASE WHEN starts_with(s, 'http') THEN s ELSE {journal_sql("(CASE WHEN j = upper(j) AND (contains(j, ' ') OR length(j) > 6) THEN array_to_string(list_transform(string_split(lower(j), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE j END)")} END AS j FROM k),
u AS (SELECT id, list_sort(list_distinct(list(j))) AS js FROM n WHERE j <> '' GROUP BY id)
SELECT f.id, array_to_string(coalesce(js, []), '|') AS journals, coalesce(contains(lower(t2), 'cochrane'), false) AS is_cochrane, coalesce(contains(t2, '//clinicaltrials.gov'), false) AS is_trial FROM f LEFT JOIN u ON u.id = f.id"""
)
def read_journals(spark, d):
    """Journals of J2, T2, T3, OP and VL: their parts and other spellings in their normal forms."""
    found = ris.items(through_ris(spark, d, "part", "p_partkey", _JOURNALS))
    return found.select("id", F.array_join(F.array_sort("journals"), "|").alias("journals"), "is_cochrane", "is_trial")


_TRIALS = lines("'TY  - JOUR'", "'AU  - Nct'", "'TI  - Trial ' || url", "CASE WHEN page_id % 2 = 0 THEN 'UR  - http://clinicaltrials.gov/study/NCT' || lpad(CAST(page_id AS STRING), 8, '0') ELSE 'T2  - https://clinicaltrials.gov/study/NCT' || lpad(CAST(page_id AS STRING), 8, '0') END", "CASE WHEN page_id % 3 = 0 THEN 'UR  - ' || url END", "'ID  - ' || CAST(page_id AS STRING)")


@query("SELECT page_id AS id, true AS is_trial, 'Trial ' || url AS title, 'https://clinicaltrials.gov' AS journals, nullif(ltrim(CAST(page_id AS VARCHAR), '0'), '') AS page_start, 0 AS authors FROM pages")
def read_trials(spark, d):
    """Registered trials: the study's number is the page, the register the journal, the title stays as it is."""
    found = ris.items(through_ris(spark, d, "pages", "page_id", _TRIALS))
    return found.select("id", "is_trial", "title", F.array_join("journals", "|").alias("journals"), "page_start", F.size("authors").alias("authors"))

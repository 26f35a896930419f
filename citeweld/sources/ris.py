"""RIS files as records, and records as bibliographic items.

Files are read by their ER lines as record ends, so a record is never cut in two by a split; the order of the file, which
decides what is kept of duplicates, becomes ``pos``. A record's fields are parsed by SQL functions. Items follow from the
fields by rules that depend on each other's order, and are made in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .. import schema
from ..functions import normal
from ..functions import patterns as P
from ..functions.pages import pages
from ..spark import in_order

#: Java forms of the line rules.
_RECORD_END = "\nER  -"
_TAG = "^[A-Z][A-Z0-9] {2}-[ ,\\u00A0]"
_SPACE = "[\\p{Zs}\\p{Zl}\\p{Zp}\\u0009\\u000B\\u000C\\u000D&&[^ ]]"


class InvalidRis(ValueError):
    """The input is no RIS export that can be linked."""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, fields) of each record under path; pos is 1, 2, ... in the order of the file.

    Dashes and spaces are made uniform, empty values and the value NA skipped, and continuation lines kept with their field.
    """
    raw = spark.read.option("lineSep", _RECORD_END).text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "^\\uFEFF", ""), "\\r\\n?", "\n"), "\\p{Pd}", "-"), "\\u2009", "")
    lines = F.filter(F.split(F.regexp_replace(text, _SPACE, " "), "\n"), lambda x: F.trim(x) != "")
    # what follows a file's last record end is no record
    last = raw.groupBy("_f").agg(F.max(F.struct("_b", "_m")).alias("_l")).select("_f", F.col("_l._b").alias("_b"), F.col("_l._m").alias("_m"))
    # what stands on the line of the record end before is not part of this record
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(_TAG), F.concat(F.lit("\u0001"), x)).otherwise(x)), "\n")
    fields = F.transform(F.filter(F.split(marked, "\u0001"), lambda x: x.rlike(_TAG)), _field)
    wanted = F.filter(fields, lambda f: (f["value"] != "") & (f["value"] != "NA") | (F.size(f["more"]) > 0))
    records = raw.join(last, ["_f", "_b", "_m"], "left_anti").select("_f", "_b", "_m", wanted.alias("fields")).where(F.exists("fields", lambda f: f["tag"] == "TY"))
    return in_order(records, ["_f", "_b", "_m"]).select((F.col("row_no") + 1).alias("pos"), "fields")


def _field(x):  # noqa: ANN001, ANN202
    parts = F.split(x, "\n")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda y: y != "")
    return F.struct(F.substring(x, 1, 2).alias("tag"), F.trim(F.substr(F.get(parts, F.lit(0)), F.lit(7))).alias("value"), rest.alias("more"))


def item_of(fields: list[dict]) -> dict:
    """One item from the fields of a record in their order."""
    people: list[tuple[str, str | None, bool]] = []
    titles: dict[str, None] = {}
    journals: dict[str, None] = {}
    dois: dict[str, None] = {}
    isbns: dict[str, None] = {}
    issns: dict[str, None] = {}
    at: dict[str, str] = {}
    out = {"id": None, "reference_type": None, "year": 0, "title": None, "is_reply": False, "is_phase": False, "is_cochrane": False, "is_trial": False, "label": None}
    raw_title = raw_journal = None

    def add_journal(s: str, tag: str) -> None:
        out["is_cochrane"] |= "cochrane" in s.lower()
        journals.update(dict.fromkeys(normal.journals(s, tag)))

    def add_title(s: str) -> None:
        if journals.keys() & set(P.RAW_TITLE_SERIES):
            titles.clear()
            titles[s] = None
            return
        original, found = normal.titles(s)
        titles.update(dict.fromkeys(found))
        if original is not None:
            out["title"] = original

    def numbers(s: str) -> None:
        b, n = normal.isbns_issns(s)
        isbns.update(dict.fromkeys(b))
        issns.update(dict.fromkeys(n))

    def trial(s: str) -> str | None:
        if s.startswith("http") and "//clinicaltrials.gov" in s:
            out["is_trial"] = True
            return s.replace("http:", "https:")
        return None

    owner = None  # the field that lines without a tag belong to: a skipped field has none
    for f in fields:
        tag, s, more = f["tag"], f["value"], f["more"] or []
        if s and s != "NA":
            owner = tag
            if tag == "AU":
                people += [a for a in map(normal.author, s.split("; ") if "; " in s else [s]) if a[0] is not None]
            elif tag == "DO":
                if s.startswith("ARTN "):
                    at["C7"] = s
                else:
                    dois.update(dict.fromkeys(normal.dois(s)))
            elif tag in ("C7", "SE", "SP"):
                at[tag] = s
            elif tag == "EP":
                at["SP"] = f"{at.get('SP', '')}-{s}"
            elif tag == "ID":
                if not s.lstrip("-").isdigit():
                    raise InvalidRis(f"an ID field is not a number: {s}")
                out["id"] = int(s)
            elif tag == "J2":
                add_journal(s, tag)
            elif tag == "LB":
                out["label"] = s
            elif tag == "OP":
                add_journal(s, tag) if out["reference_type"] == "CONF" else add_title(s)
            elif tag == "PY":
                out["year"] = normal.year(s)
            elif tag == "SN":
                numbers(s)
            elif tag == "ST":
                add_title(s)
            elif tag == "T2":
                raw_journal = s
                add_journal(trial(s) or s, tag)
            elif tag == "T3":
                if not s.startswith("Retract") and not P.CONFERENCE.fullmatch(s) and len(s) > 3:
                    add_journal(s, tag)
                    add_title(s)
            elif tag == "TI":
                add_title(s)
                if normal.is_reply(s):
                    out["is_reply"], out["title"] = True, s
                out["is_phase"] |= normal.is_phase(s)
                raw_title = s
            elif tag == "TY":
                out["reference_type"] = s
            elif tag == "UR":
                if (url := trial(s)) is not None:
                    add_journal(url, tag)
            elif tag == "VL":
                if len(s) > 10 and raw_journal is not None:
                    add_journal(f"{raw_journal}. {s}", tag)
        for line in more:
            if owner == "DO":
                dois.update(dict.fromkeys(normal.dois(line)))
            elif owner == "SN":
                numbers(line)
            elif owner == "TI":
                if out["reference_type"] == "CHAP":
                    titles.clear()
                add_title(line)
            elif owner == "UR" and (url := trial(line)) is not None:
                add_journal(url, "UR")
    if out["is_trial"]:
        people = []
        study = next((j for j in journals if j.startswith("https://clinicaltrials.gov")), None)
        if study is not None and study[-11:].startswith("NCT"):
            at["SP"] = study[-11:]
            del journals[study]
            journals["https://clinicaltrials.gov"] = None
        out["title"] = raw_title
    if out["is_cochrane"] and not at and (page := normal.cochrane_page(list(dois))) is not None:
        at["C7"] = page
    p = pages(at.get("C7"), at.get("SE"), at.get("SP"))
    if p.several and not journals.keys() & set(P.RAW_TITLE_SERIES):
        titles.update(dict.fromkeys([t[::-1] for t in titles]))
    return out | {"authors": [a for a, _, _ in people], "all_authors": normal.all_authors(people), "titles": list(titles), "journals": list(journals), "dois": list(dois), "isbns": list(isbns), "issns": list(issns), "page_start": p.start, "pages_output": p.output, "several_pages": p.several}


_ITEM_SQL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.ITEM.fields)
BATCH_CHARS = 1 << 22  # of the rows that go back together: the forms of a long title come to its length squared
PARSED = 32  # records that are made Python's together


def _room(row: dict) -> int:
    return sum(len(v) if isinstance(v, str) else sum(map(len, v)) if isinstance(v, list) else 8 for v in row.values())


def items_as(records: DataFrame, row_of: Callable[[dict], dict], columns: str, old: bool = False, labels: bool = False) -> DataFrame:
    """The rows that row_of makes of each item, with these columns; what it leaves out of an item is never kept or sent."""
    kinds = _parse_datatype_string(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(kinds)
        rows, room = [], 0
        for b in batches:
            for at in range(0, b.num_rows, PARSED):
                part = b.slice(at, PARSED)
                for pos, fields in zip(part["pos"].to_pylist(), part["fields"].to_pylist(), strict=True):
                    x = item_of(fields)
                    x |= {"pos": pos, "is_old": old, "id": pos if x["id"] is None else x["id"], "label": x["label"] if labels else None}
                    rows.append(row_of(x))
                    room += _room(rows[-1])
                    if room > BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema=form)
                        rows, room = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=form)

    return records.select("pos", "fields").mapInArrow(run, columns)


def items(records: DataFrame, old: bool = False, labels: bool = False) -> DataFrame:
    """Bibliographic items of records; labels are read from LB fields only when asked for. Records without an id get their pos."""
    names = [f.name for f in schema.ITEM.fields]
    return items_as(records, lambda x: {n: x[n] for n in names}, _ITEM_SQL, old, labels)


def read_items(spark: SparkSession, path: str, old: bool = False, labels: bool = False) -> DataFrame:
    return items(read_records(spark, path), old, labels)


def check(found: DataFrame) -> None:
    """Raises InvalidRis if there is no record, or if ids repeat."""
    if found.isEmpty():
        raise InvalidRis("no records found")
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        raise InvalidRis("the ids are not unique")

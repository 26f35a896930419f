"""Patterns and word lists of the normalisation rules.

FIXED VALUES: results depend on these exactly; they are data, listed by the field they belong to. ``regex`` is used where
Unicode classes or look-behind of varying length are needed, ASCII word and digit classes everywhere.
"""

from __future__ import annotations

import re

import regex

A, I = re.ASCII, re.ASCII | re.IGNORECASE

# lines and text
RIS_LINE = re.compile(r"([A-Z][A-Z0-9])( {2}-[ , ])(.*)")
DASH = regex.compile(r"\p{Pd}")
THIN_SPACE = " "
UNUSUAL_SPACE = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}\t\n\x0b\x0c\r]")

# identifiers and years
DOI = re.compile(r"\b(10.\d{4,9}/[-._;()<>/:a-z0-9]+)\b", A)
ISSN_ISBN = re.compile(r"\b([-\dxX]{8,17})\b", A)
YEAR = re.compile(r"(^|\D)(\d{4})(\D|$)", A)
FIRST_YEAR = 1850
LONGEST_DOI_FIELD = 200
COCHRANE_DOI = re.compile(r"^.*10.1002/14651858.([a-z][a-z]\d+).*", I)

# authors
NOT_A_PERSON = re.compile(r"\b(anonymous|No authorship, indicated|consortium|et al|grp|group|nct|study)\b", I)
NAME_ADDITION = re.compile(r"^(.+)\b(jr|sr|1st|2nd|3rd|ii|iii)\b(.*)$", I)
MOST_AUTHORS = 40

# titles
NO_TITLES = ("not available", "[not available]", "untitled")
NUMBERS_ONLY = re.compile(r"[-\d]+", A)
RETRACTED_END = re.compile(r"(.+)\(Retracted [Aa]rticle.*\)", A)
RETRACTED_START = re.compile(r"((retracted|removed|review|withdrawn)( article)?[.:] )(.+)", I)
REPRINTED_END = re.compile(r"(.+)\(Reprinted .*", A)
REPRINT_START = re.compile(r"Reprint( of)?:(.+)", I)
TRADEMARK = re.compile(r"(.+)(\((R|TM)\))(.+)", A)
SUBTITLE_HYPHEN = regex.compile(r"(.*(?<!( and| of| or|,|\d)))( -)([ A-Za-z]+)", regex.ASCII)
LEADING_NUMBER = re.compile(r"(\d+)(.+)", A)
TITLE_SUBTITLE = re.compile(r"^(.{20,}?)[:.?;] (.{40,})$", A)
END_PUNCTUATION = regex.compile(r"(?:(?![)\]])\p{P})+$")
LANGUAGE_END = re.compile(r"(\(?(chinese|dutch|french|german|italian|japanese|polish|russian|spanish)( text)?\)?)$", A)
TRANSLATION_END = re.compile(r"(\(author's transl\))$", A)
CASE_REPORT = re.compile(r"^case (reports?|series|[-\d]+)[.:] ", I)
BRACKETS_END = re.compile(r".\[[^\\]+\]$", A)
POINTED = re.compile(r"<[^>]+>+", A)
ROUND = re.compile(r"[()]")
NOT_LOWER_ALNUM = re.compile(r"[^a-z0-9]")
SPACES = re.compile(r"\s{2,}", A)
LEADING_ARTICLE = re.compile(r"^(the|a|an) ")

# flags of a title
REPLY = re.compile(r"(^C(omment|OMMENT)|^R[Ee]: .+|.*\breply\b.*|.*author(.+)respon.*|^response$)", A)
ERRATUM = re.compile(r"(^(Correction|Corrigendum|Erratum)( to (?=[A-Z])| to '|( to)?: ).*)|(.*(Correction|Corrigendum|Erratum)$)", A)
SOURCE_END = re.compile(r".+(\(vol \d+\D+\d+\D+\d+\D*\))", A)
COMMENT = re.compile(r"(e)?(Comment|COMMENT)(|s|S|ary)\b.*|.+[cC]omment(|s|ary)( from| on| to)?:? ([A-Z'\"]|the).+|.+[Cc]omment(|s|ary)|.+COMMENT|.*[Ii]nvited [Cc]ommen.+", A)
PHASE = re.compile(r".*phase\s[\di].*", I)

# journals
CONFERENCE = re.compile(r"((^\d)|(.*(\d{4}|Annual|Conference|Congress|Meeting|Society|Symposium))).*", A)
JOURNAL_EXTRA = re.compile(r"(.+?)(\d+|\. Conference.*)", A)
JOURNAL_SPLIT = re.compile(r"[\[\]]|[=|/]|[.] ")
JOURNAL_SPLIT_ABBREVIATED = re.compile(r"[\[\]]|[=|/]")
SUPPLEMENT = re.compile(r"(\b(Suppl|Supplement|Supplementum)\b.*)$", I)
NO_JOURNALS = ("electronic resource", "et al.", "technical report")
ABBREVIATIONS = (
    (re.compile("Jpn"), "Japanese"),
    (re.compile("Dtsch"), "Deutsch"),
    (re.compile("eneeskd"), "eneeskunde"),
    (re.compile("heilkd"), "heilkunde"),
    (re.compile("Kongressbd"), "Kongressband"),
    (re.compile(r"Monbl\b", I), "Monatsbl"),
    (re.compile("Natl"), "National"),
    (re.compile(r"^Zbl[. ]", I), "Zentralbl"),
    (re.compile("Jbr-btr", I), "JBR BTR"),
    (re.compile(r"^(Rofo|Fortschritte .* Gebiet.* R.ntgenstrahlen)", I), "Rofo"),
)
LATIN_O = re.compile(r"o-(\S)", A)
HYPHEN_DOT = re.compile(r"[.-]")
JOURNAL_ARTICLE = re.compile(r"^(The |Le |La |Les |L'|Der |Die |Das |Il |Het )")
GENITIVE = re.compile(r"'s\b", A)
ROUND_END = re.compile(r"\([^)]+\)$")
JOURNAL_ADDITION = re.compile(r"[:/]\s.*$", A)
NOT_ALNUM = re.compile(r"[^a-z0-9]", I)
#: Series whose titles are kept as they are.
RAW_TITLE_SERIES = ("Molecular Imaging and Contrast Agent Database", "National Cancer Inst Carcinog Tech Rep Ser", "National Toxicol Program Tech Rep Ser", "Ont Health Technol Assess Ser")

# pages
PAGE_HYPHENS = re.compile("[‐­]")
PAGE_ADDITION = re.compile(r"^(UNSP|Article|ARTN)\s*", I)
PAGE_MERGE_FOUR = regex.compile(r"(?<!\d+)([a-zA-Z0-9]+)-(\d+)-([a-zA-Z0-9]+)-(\d+)", regex.ASCII)
PAGE_MERGE_TWO = regex.compile(r"(?<!\d+)([a-zA-Z]+)-(\d+)", regex.ASCII)
MONTH = re.compile(r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", A)
ROMAN_ONLY = re.compile(r"[ivxlcmIVXLCM\-]+")
VOLUME_PAGE = re.compile(r"[Vv]\d+:\d+", A)
LONGEST_SE = 30
ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))

"""Text functions from Column to Column: folding, identifiers, slugs, tokens, parsing."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters beyond those that are never combining marks.
_FAR = re.compile("[^\x00-\u02ff]")


def decomposed(value: str, form: str, ascii_only: bool) -> str:
    """A text in a decomposed form without combining marks, or without anything but ASCII."""
    parts = unicodedata.normalize(form, value)
    if ascii_only:
        return parts.encode("ascii", "ignore").decode()
    for c in set(_FAR.findall(parts)):
        if unicodedata.combining(c):
            parts = parts.replace(c, "")
    return parts


@cache
def _decomposer(form: str, ascii_only: bool):
    def decompose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: decomposed(x, form, ascii_only), na_action="ignore")

    return F.pandas_udf(decompose, T.StringType())


def _decomposed(col: Column, form: str, ascii_only: bool) -> Column:
    """Only texts with other than ASCII characters leave the JVM: Spark has no decomposition of its own."""
    other = col.rlike(r"[^\x00-\x7F]")
    return F.when(~other, col).otherwise(_decomposer(form, ascii_only)(F.when(other, col)))


def collapse(col: Column) -> Column:
    """Runs of white space become one space, and none is left at the ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def fold(col: Column, mode: str) -> Column:
    """A comparable form of a text; ``mode`` names which.

    library_name   ascii, lower, hyphens and runs of space as one space
    validate_name  the same but for hyphens
    work_text      ascii, lower, runs of anything but letters and digits as one space
    author_name    canonical ascii, lower, punctuation deleted, space collapsed
    combining      only combining marks dropped, lower
    combining_trim the same with space collapsed
    lower_punct    lower, punctuation as space, accents kept
    alias_key      lower, space collapsed, accents kept
    token_norm     canonical ascii, lower, trimmed
    """
    if mode == "library_name":
        return collapse(F.replace(F.lower(_decomposed(col, "NFKD", True)), F.lit("-"), F.lit(" ")))
    if mode == "validate_name":
        return collapse(F.lower(_decomposed(col, "NFKD", True)))
    if mode == "work_text":
        return F.trim(F.regexp_replace(F.lower(_decomposed(col, "NFKD", True)), "[^a-z0-9]+", " "))
    if mode == "author_name":
        return collapse(F.regexp_replace(F.lower(_decomposed(col, "NFD", True)), r"[^\w\s]", ""))
    if mode == "combining":
        return F.lower(_decomposed(col, "NFKD", False))
    if mode == "combining_trim":
        return collapse(F.lower(_decomposed(col, "NFKD", False)))
    if mode == "lower_punct":
        return collapse(F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", " "))
    if mode == "alias_key":
        return collapse(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")))
    if mode == "token_norm":
        return F.trim(F.lower(_decomposed(col, "NFD", True)))
    raise ValueError(f"no fold mode {mode!r}")


def fold_value(value: str) -> str:
    """What ``fold(col, 'combining')`` makes of one value."""
    return decomposed(value, "NFKD", False).lower()


def fold_items(values: Column) -> Column:
    """``fold(col, 'combining')`` of each item of an array; nulls are left out."""
    joined = F.array_join(values, "\u0001")
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(F.split(fold(joined, "combining"), "\u0001"))


def filled(col: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(col, F.lit(""))


def normalize_doi(col: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"^https?://(?:dx\.)?doi\.org/", "")
    return F.regexp_replace(bare, r"[. ]+$", "")


def extract_orcid(col: Column) -> Column:
    """The first ORCID in a text, or null."""
    return filled(F.regexp_extract(col, r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]", 0))


def orcid_valid(col: Column) -> Column:
    """Whether an ORCID has its form and ISO 7064 mod 11-2 check digit."""
    digits = F.replace(col, F.lit("-"), F.lit(""))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda t, i: (t + F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))) * 2)
    check = F.pmod(F.lit(12) - total % 11, F.lit(11))
    last = F.substring(digits, 16, 1)
    return F.coalesce(col.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$") & (F.when(check == 10, F.lit("X")).otherwise(check.cast("string")) == last), F.lit(False))


def slug(col: Column, variant: str = "runs", most: int = 60) -> Column:
    """``runs``: anything else becomes one hyphen; ``delete``: punctuation goes; ``cut``: ``runs`` cut short."""
    plain = F.lower(_decomposed(col, "NFKD", True))
    if variant == "delete":
        kept = F.regexp_replace(plain, r"[^a-z0-9\s-]", "")
        return F.trim(F.regexp_replace(F.trim(kept), r"[\s-]+", "-"), F.lit("-"))
    runs = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(runs, 1, most) if variant == "cut" else runs


def tokens(col: Column) -> Column:
    """Non-empty space separated parts."""
    return F.filter(F.split(col, r"\s+"), lambda t: t != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two titles as token sets; 0 if either is empty."""
    x, y = (F.array_distinct(tokens(fold(F.coalesce(c, F.lit("")), "lower_punct"))) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


#: Words that do not tell people apart (fixed values).
STOP_WORDS = ["de", "da", "do", "dos", "das", "e", "a", "o", "em", "no", "na"]


def significant_tokens(col: Column) -> Column:
    return F.filter(tokens(fold(col, "token_norm")), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1))


def clean_text(col: Column) -> Column:
    return collapse(F.replace(col, F.lit(" "), F.lit(" ")))


def first_of(values: Column, single: Column | None = None) -> Column:
    """The first of an array, else the single value."""
    head = F.try_element_at(values, F.lit(1))
    return head if single is None else F.coalesce(head, single)


def subject_area(value: Column) -> Column:
    """Name of a subject area given as JSON text: a string, an object with ``$``, or a list of either."""
    v = F.try_parse_json(value)
    paths = ("$.$", "$[0].$", "$[0]", "$")
    inner = F.coalesce(*(F.try_variant_get(v, p.replace(".$", "['$']") if p.endswith(".$") else p, "string") for p in paths[:2]), F.try_variant_get(v, "$[0]", "string"), F.when(~value.rlike(r"^\s*[\[{]"), F.try_variant_get(v, "$", "string")))
    return F.coalesce(inner, F.when(~value.rlike(r"^\s*[\[{]"), value))


def to_int_or_zero(col: Column) -> Column:
    return F.coalesce(col.try_cast("int"), F.lit(0))


def extract_int(col: Column) -> Column:
    """The first run of digits as a number, or null."""
    return filled(F.regexp_extract(col, r"(\d+)", 1)).try_cast("bigint")


def fellowship_from_text(col: Column) -> Column:
    """Level of a research fellowship named in a text, by the most exact phrase first; null if none."""
    patterns = (  # fixed values
        r"(?i)bolsista\s+de\s+produtividade\s+em\s+pesquisa\s+do\s+cnpq\s*-?\s*n[ií]vel\s+(\w+)",
        r"(?i)bolsista\s+de\s+produtividade[^.]*?n[ií]vel\s+(\w+)",
        r"(?i)bolsista\s+cnpq[^.]*?n[ií]vel\s+(\w+)",
    )
    return F.upper(F.coalesce(*(filled(F.regexp_extract(col, p, 1)) for p in patterns)))


def citation_split(col: Column) -> Column:
    """(authors, title, journal) of ``authors . title . journal , rest``; else the text's beginning as title."""
    parts = F.split(col, r" \. ")
    whole = F.size(parts) >= 3
    return F.struct(
        F.when(whole, F.transform(F.split(F.element_at(parts, 1), ";"), lambda a: F.trim(a))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(whole, F.trim(F.try_element_at(parts, F.lit(-2)))).otherwise(F.substring(col, 1, 200)).alias("title"),
        F.when(whole, F.trim(F.element_at(F.split(F.element_at(parts, -1), ","), 1))).otherwise(F.lit("")).alias("journal"),
    )


def query_param(url: Column, key: str) -> Column:
    """Decoded value of a query parameter, or null."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))


def url_join(base: Column, link: Column) -> Column:
    """A link made absolute: whole addresses stay, ``//``, ``/``, ``?``, ``#`` and relative paths are resolved."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.when(path == "", F.lit("/")).otherwise(F.lit("")))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
        .when(link == "", base)
        .otherwise(F.concat(origin, folder, F.regexp_replace(link, r"^(\./)+", "")))
    )


def route_file(url: Column, base_path: str = "/") -> Column:
    """File that a site serves for an address: its path, below the base, with the index of a folder."""
    path = F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")), F.lit(""))
    inner = F.regexp_replace(path, f"^{base_path.rstrip('/')}/?", "")
    return F.when((inner == "") | inner.endswith("/"), F.concat(inner, F.lit("index.html"))).when(F.element_at(F.split(inner, "/"), -1).contains("."), inner).otherwise(F.concat(inner, F.lit("/index.html")))


#: Letters read in Latin-2 that were written in Latin-1 (fixed values).
MOJIBAKE, REPAIRED = "ęăőŕűůňřčđ", "êãõàûùòøèð"


def mojibake_fix(col: Column) -> Column:
    return F.translate(col, MOJIBAKE, REPAIRED)


def age_days(then: Column, now: Column) -> Column:
    """Whole days from then to now, not below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 86400)).cast("long")


#: Forms of identifiers (fixed values).
ID_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
FILE_NAME_PATTERN = r"^[a-z0-9][a-z0-9._-]*$"
EID_PREFIX = "2-s2.0-"


def id_valid(col: Column) -> Column:
    return F.coalesce(col.rlike(ID_PATTERN), F.lit(False))


def eid_number(col: Column) -> Column:
    """The number of a prefixed work id; null if the prefix or the digits are missing."""
    return filled(F.regexp_extract(col, r"^2-s2\.0-(\d+)$", 1))


def localized(col: Column, lang: str) -> Column:
    """Text of a bilingual struct in the asked language, else the first that is filled of pt and en, else empty."""
    order = [lang, *(x for x in ("pt", "en") if x != lang)]
    return F.coalesce(*(filled(col.getField(x)) for x in order), F.lit(""))


def hex_head(content: Column, n: int) -> Column:
    """The first bytes of a file as hexadecimal digits."""
    return F.hex(F.substring(content, 1, n))


def running(numbers: Column, block: int = 256) -> Column:
    """The sum up to each number of an array of integers: blocks are summed first, then within, as appending copies what is there."""
    none = F.array().cast("array<bigint>")

    def sums(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("all"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all")), lambda acc: acc["all"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda b: F.slice(numbers, b * block + 1, block))
    totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x))
    whole = F.zip_with(F.zip_with(sums(totals), totals, lambda upto, own: upto - own), blocks, lambda before, xs: F.transform(sums(xs), lambda x: x + before))
    return F.when(F.size(numbers) > 0, F.flatten(whole)).otherwise(none)


def carried(labels: Column, blanks: tuple[str, ...] = ("", "t"), block: int = 256) -> Column:
    """Each label of an array, or where it is blank the last one before it, empty if there is none; by blocks, as in ``running``."""

    def filled_in(xs: Column, before: Column) -> Column:
        start = F.array(before)
        return F.slice(F.aggregate(xs, start, lambda acc, x: F.array_append(acc, F.when(~x.isin(*blanks), x).otherwise(F.element_at(acc, -1)))), F.lit(2), F.size(xs))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(labels) - 1) / block).cast("int")), lambda b: F.slice(labels, b * block + 1, block))
    ends = F.transform(parts, lambda xs: F.coalesce(F.try_element_at(F.filter(xs, lambda x: ~x.isin(*blanks)), F.lit(-1)), F.lit("")))
    begins = F.concat(F.array(F.lit("")), filled_in(ends, F.lit("")))
    whole = F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), filled_in))
    return F.when(F.size(labels) <= block, filled_in(labels, F.lit(""))).otherwise(whole)

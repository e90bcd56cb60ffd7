"""Jobs over pages of HTML and text: catalogue tables, references, profiles, scans, files.

Parsers run batch by batch in ``mapInPandas`` / ``mapInArrow``; everything after them is DataFrame work.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblio.functions.text import FILE_NAME_PATTERN, carried, clean_text, extract_int, fellowship_from_text, mojibake_fix, query_param, route_file, running, url_join

from .arrange import parse_blocks


#: Tags of plain markup with quoted attributes, and the elements that may stand there; none of them changes how what follows is read.
_TAG = re.compile(r"""<(/?)([a-z][a-z0-9]*)((?: [a-z-]+="[^"<>&]*")*)>""")
_HREF = re.compile(' href="([^"]*)"')
_PLAIN = frozenset("html head body table caption colgroup col thead tbody tfoot tr td th a b i u em strong small big sub sup font span center div p br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd img".split())


class _Parts(HTMLParser):
    """A page as ``_TAG.split`` would cut it, whatever its markup: a text, then four items a tag; texts that follow no tag get one without a name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = [""]

    def handle_starttag(self, tag, attrs):
        self.parts += ("", tag, (dict(attrs).get("href") or "") if tag == "a" else "", "")

    def handle_endtag(self, tag):
        self.parts += ("/", tag, "", "")

    def handle_data(self, data):
        self.parts += ("", "", "", data)


def _table(page: str) -> list[list[tuple]]:
    """Rows of the first table of a page: text, first link, its text and whether it is a header, of each cell.

    Plain markup is cut at its tags in one go; ``HTMLParser`` reads anything else.
    """
    parts = _TAG.split(page)
    plain = "&" not in page and page.count("<") == len(parts) // 4 and _PLAIN.issuperset(parts[2::4])
    if not plain:
        parser = _Parts()
        parser.feed(page)
        parser.close()
        parts = parser.parts
    depth, rows, cell = 0, [], False
    text = href = link = head = within = None
    for end, name, attributes, data in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4], strict=True):
        if name in ("td", "th", "tr") or (end and name == "table" and depth):
            if cell and (end or depth):
                rows[-1].append((text, href, link, head))
                cell = False
            if end:
                if name == "table":
                    depth -= 1
                    if not depth:
                        break
            elif depth and name == "tr":
                rows.append([])
            elif depth and rows:
                cell, text, href, link, head, within = True, "", None, "", name == "th", False
        elif name == "table":
            depth += not end
        elif name == "a" and cell:
            if end:
                within = False
            elif href is None:
                href, within = (_HREF.findall(attributes) or [""])[-1] if plain else attributes, True
        if cell and (data := data.strip()):
            text = f"{text} {data}" if text else data
            if within:
                link = f"{link} {data}" if link else data
    return rows


_CELL = "struct<text:string,href:string,link:string,head:boolean>"


def tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, table[][]) with the cells of each page's first table; null for a page without one."""

    def per_batch(batches):
        for batch in batches:
            tops, rows, cells = [], [0], []
            for text in batch.column(1).to_pylist():
                table = _table(text or "")
                tops.append(len(rows) - 1 if table else None)
                for r in table:
                    cells += r
                    rows.append(len(cells))
            tops.append(len(rows) - 1)
            fields = [pa.array(x, kind) for x, kind in zip(zip(*cells, strict=True) if cells else ((),) * 4, (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)]
            each = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(fields, ["text", "href", "link", "head"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(tops, pa.int32()), each)], names=["page", "table"])

    kind = pages.schema[page].dataType.simpleString()
    return pages.select(page, html).mapInArrow(per_batch, f"page {kind}, table array<array<{_CELL}>>")


def table_rows(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, row, cells[]) of each page's first table; a page without one has a row with null ``row``."""
    return tables(pages, page, html).select("page", F.posexplode_outer("table").alias("row", "cells"))


def extract_catalogue(pages: DataFrame, kind: str, base_url: str, course: str = "") -> tuple[DataFrame, DataFrame]:
    """(records, status) of catalogue lists; ``kind`` is ``theses`` or ``graduations``.

    A record needs five cells (six for theses), a title link and an id in its query.  A page fails that has no table or
    gives no record.
    """
    key = "num_tese" if kind == "theses" else "num_tg"
    rows = table_rows(pages)
    data = rows.withColumn("c", F.filter("cells", lambda x: ~x["head"]))
    least = 6 if kind == "theses" else 5

    def cell(i: int) -> Column:
        return F.try_element_at("c", F.lit(i + 1))

    ok = (F.size("c") >= least) & cell(1)["href"].isNotNull()
    fields = {"program": 3, "year": 4, "course": 5} if kind == "theses" else {"course": 3, "year": 4}
    pdf = cell(6 if kind == "theses" else 5)["href"]
    records = data.filter(ok).select(
        "page",
        "row",
        clean_text(query_param(url_join(F.lit(base_url), cell(1)["href"]), key)).alias("id"),
        clean_text(cell(1)["link"]).alias("title"),
        clean_text(F.when(cell(2)["href"].isNotNull(), cell(2)["link"]).otherwise(cell(2)["text"])).alias("author"),
        url_join(F.lit(base_url), cell(1)["href"]).alias("detail_url"),
        *((F.lit(course) if course and n == "course" else mojibake_fix(clean_text(cell(i)["text"]))).alias(n) for n, i in fields.items()),
        F.coalesce(url_join(F.lit(base_url), pdf), F.lit("")).alias("pdf_url"),
    ).filter("id <> ''")
    n = records.groupBy("page").agg(F.count(F.lit(1)).alias("records"))
    status = rows.groupBy("page").agg(F.count("row").alias("_t")).join(n, "page", "left").select("page", F.coalesce("records", F.lit(0)).alias("records"), F.when(F.col("_t") == 0, "no table").when(F.col("records").isNull(), "no records").otherwise("ok").alias("status"))
    return records, status


#: Labels of a detail page and the fields they name (fixed values).
LABELS = {
    "título": "title", "titulo": "title", "autor": "author", "programa": "program", "área de concentração": "area",
    "area de concentracao": "area", "orientador": "advisors", "orientadores": "advisors", "co-orientador": "co_advisors",
    "coorientador": "co_advisors", "co-orientadores": "co_advisors", "coorientadores": "co_advisors",
    "ano de publicação": "year", "ano de publicacao": "year", "curso": "course", "assunto": "subjects", "assuntos": "subjects",
    "resumo": "abstract", "data de defesa": "defense_date", "texto na íntegra": "fulltext", "texto na integra": "fulltext",
}
REPEATED = ("advisors", "co_advisors", "subjects")


def extract_detail(pages: DataFrame, base_url: str) -> DataFrame:
    """(page, field, pos, value) of detail pages: labels carry forward, lists accumulate, other fields keep the first.

    A page's rows stay together, so that nothing is shuffled; an id that comes twice is two pages.
    """
    rows = F.transform("table", lambda r, i: F.struct(i.alias("row"), F.filter(r, lambda x: ~x["head"]).alias("c")))
    long = tables(pages).select("page", F.filter(rows, lambda r: F.size(r["c"]) >= 2).alias("rows"))
    labels = F.transform("rows", lambda r: F.lower(F.regexp_replace(clean_text(F.element_at(r["c"], 1)["text"]), ":+$", "")))
    named = long.select("page", "rows", labels.alias("labels")).select("page", "rows", carried(F.col("labels")).alias("labels"))
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))

    def field(label: Column) -> Column:
        other = F.when(label.contains("orientador"), F.when(label.startswith("co"), "co_advisors").otherwise("advisors"))
        return F.coalesce(F.try_element_at(known, label), other)

    told = named.select("page", "rows", F.transform("labels", field).alias("fields"))
    text = F.zip_with("rows", "fields", lambda r, f: F.when(f.isin(*REPEATED), F.struct(f.alias("field"), r["row"].alias("pos"), clean_text(F.element_at(r["c"], 2)["text"]).alias("value"))))
    lists = F.filter(text, lambda x: x["value"] != "")

    def first(name: str) -> Column:
        at = F.array_position("fields", name).cast("int")
        row = F.try_element_at("rows", F.nullif(at, F.lit(0)))
        cell = F.element_at(row["c"], 2)
        value = F.coalesce(url_join(F.lit(base_url), cell["href"]), F.lit("")) if name == "fulltext" else clean_text(cell["text"])
        return F.when(at > 0, F.struct(F.lit("fulltext_url" if name == "fulltext" else name).alias("field"), row["row"].alias("pos"), value.alias("value")))

    single = F.array_compact(F.array(*(first(n) for n in dict.fromkeys(LABELS.values()) if n not in REPEATED)))
    return told.select("page", F.inline(F.concat(lists, single)))


_ATTRIBUTES = r"""(?is)<[a-z][^>]*?\s(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def extract_references(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, attr, value) of every ``href`` and ``src``."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<[a-z][^>]*>"), F.lit(0))
    rows = pages.select(F.col(page).alias("page"), F.posexplode(tags).alias("pos", "tag"))
    each = F.explode(F.array_compact(F.array(*(F.when(F.col("tag").rlike(rf"(?is)\s{a}\s*="), F.struct(F.lit(a).alias("attr"), F.coalesce(F.nullif(F.regexp_extract("tag", rf'(?is)\s{a}\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("tag", rf"(?is)\s{a}\s*=\s*'([^']*)'", 1), F.lit("")), F.regexp_extract("tag", rf"(?is)\s{a}\s*=\s*([^\s>\"']*)", 1)).alias("value"))) for a in ("href", "src")))))
    return rows.select("page", "pos", each.alias("x")).select("page", "pos", "x.attr", "x.value")


def unsafe_blank_links(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Links that open a new window without both ``noopener`` and ``noreferrer``."""
    tags = pages.select(F.col(page).alias("page"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))).alias("tag"))
    rel = F.lower(F.regexp_extract("tag", r"""(?is)\srel\s*=\s*["']?([^"'>]*)""", 1))
    return tags.filter(F.col("tag").rlike(r"""(?i)\starget\s*=\s*["']?_blank""") & ~(rel.contains("noopener") & rel.contains("noreferrer")))


def check_links(pages: DataFrame, targets: DataFrame, base_url: str, page: str = "page_id", url: str = "url") -> DataFrame:
    """(page, value, target) of links within the site that lead to no target file; ``targets`` has ``path``."""
    refs = extract_references(pages.withColumnRenamed(page, "page_id"), "page_id").join(pages.select(F.col(page).alias("page"), F.col(url).alias("_url")), "page")
    whole = url_join(F.col("_url"), F.col("value"))
    origin = base_url.split("//", 1)[-1].split("/", 1)[0]
    base_path = "/" + (base_url.split("//", 1)[-1].split("/", 1) + [""])[1]
    local = refs.filter(~F.col("value").rlike(r"(?i)^(?:mailto|tel|data|javascript):|^#")).withColumn("_whole", whole).filter(F.coalesce(F.try_parse_url("_whole", F.lit("HOST")) == origin, F.lit(False)))
    aimed = local.withColumn("path", route_file(F.col("_whole"), base_path))
    return aimed.join(targets.select("path").distinct(), "path", "left_anti").select("page", "value", F.col("path").alias("target"))


def marker_values(pages: DataFrame, attr: str, page: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(F.col(page).alias("page"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(rf"""(?i)\s{re.escape(attr)}\s*=\s*["']([^"']*)["']"""), F.lit(1)))).alias("id"))


def marker_coverage(pages: DataFrame, expected: DataFrame, attr: str, page: str = "page_id") -> DataFrame:
    """(id, problem): expected ids that no page marks, and marks that nobody expects."""
    found = marker_values(pages, attr, page).select("id").distinct()
    missing = expected.select("id").join(found, "id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(found.join(expected.select("id"), "id", "left_anti").withColumn("problem", F.lit("unexpected")))


def _by_class(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'(?is)class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</', 1)


def extract_profile(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Counters a source, fellowship level, id link and summary of profile pages with sections by class."""
    parts = F.slice(F.split(F.col(html), r'(?i)<div[^>]*class="[^"]*\bscience_cont\b[^"]*"[^>]*>'), 2, 1 << 30)
    counters = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(_by_class(p, "web_s"), "<[^>]*>", "")).alias("source"), F.coalesce(extract_int(_by_class(p, "trab")), F.lit(0)).alias("works"), F.coalesce(extract_int(_by_class(p, "cita")), F.lit(0)).alias("citations"), F.coalesce(extract_int(_by_class(p, "fator")), F.lit(0)).alias("h_index")))
    return pages.select(F.col(page).alias("page"), counters.alias("counters"), fellowship_from_text(F.regexp_replace(html, "<[^>]*>", " ")).alias("fellowship"), F.nullif(F.regexp_extract(html, r"authorId=(\d+)", 1), F.lit("")).alias("source_id"), clean_text(_by_class(F.col(html), "resumo")).alias("summary"))


def extract_articles(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """One row an article block: DOI, year, two citation counters, title and journal."""
    from biblio.functions.text import citation_split

    blocks = pages.select(F.col(page).alias("page"), F.posexplode(F.slice(F.split(F.col(html), r'(?i)<div[^>]*class="[^"]*\bartigo-completo\b[^"]*"[^>]*>'), 2, 1 << 30)).alias("pos", "b"))
    text = clean_text(F.regexp_replace(F.regexp_extract("b", r'(?is)<span[^>]*class="[^"]*\btransform\b[^"]*"[^>]*>(.*)', 1), r"<[^>]*>", " "))

    def order(kind: str) -> Column:
        return F.regexp_extract("b", rf'(?is)data-tipo-ordenacao="{kind}"[^>]*>\s*(\d+)', 1).try_cast("int")

    parts = citation_split(text)
    return blocks.select("page", "pos", F.regexp_extract("b", r'(?i)href="(?:https?://(?:dx\.)?doi\.org/)([^"]*)"', 1).alias("doi"), order("ano").alias("year"), F.coalesce(order("1"), F.lit(0)).alias("citations_a"), F.coalesce(order("3"), F.lit(0)).alias("citations_b"), parts["title"].alias("title"), parts["journal"].alias("journal"))


def extract_blocks(texts: DataFrame, key: str, text: str, header: str, fields: dict[str, str], stop: str | None = None) -> DataFrame:
    """(key, block, field, value) of report texts."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return parse_blocks(lines, key, "pos", header, fields, stop)


# What secrets and unsafe content look like.
SECRETS = {
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "hosting token": r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "cloud access key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "literal secret": r"(?i)\b(?:api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token)\s*[:=]\s*['\"][A-Za-z0-9_./+=-]{16,}['\"]",
}
UNSAFE = {
    "script tag": r"(?i)<\s*script\b",
    "event handler": r"(?i)\bon[a-z]+\s*=",
    "script protocol": r"(?i)javascript\s*:",
    "embedded content": r"(?i)<\s*(?:iframe|object|embed)\b",
    "html data url": r"(?i)data\s*:\s*text/html",
}


def scan(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, label, line) of every match; a line is the newlines before the match and one.

    One pattern of all finds the texts with any match; only these are searched label by label.  Lines are told by running sums over
    what lies between matches, so a text costs its length and its matches.
    """
    every = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns.values())
    hit = df.select(F.col(key), F.col(text).alias("_x")).filter(F.col("_x").rlike(every))
    found = F.array(*(F.struct(F.lit(label).alias("label"), F.regexp_extract_all("_x", F.lit(p), F.lit(0)).alias("hits"), F.split("_x", p).alias("parts")) for label, p in patterns.items()))
    each = hit.select(key, F.explode(found).alias("x")).filter(F.size("x.hits") > 0)

    def newlines(p: Column) -> Column:
        return F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))

    before = F.zip_with(F.slice("x.parts", F.lit(1), F.size("x.hits")), F.concat(F.array(F.lit("")), F.slice("x.hits", F.lit(1), F.size("x.hits") - 1)), lambda p, h: newlines(p) + newlines(h))
    return each.select(key, "x.label", F.explode(F.transform(running(before), lambda n: n + 1)).alias("line"))


def scan_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    return scan(df, key, text, SECRETS)


def scan_unsafe(df: DataFrame, key: str, text: str) -> DataFrame:
    return scan(df, key, text, UNSAFE)


#: Beginnings of files by kind, and size limits (fixed values).
MAGIC = {"jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "webp": "52494646", "pdf": "255044462D"}
MAX_BYTES = {"pdf": 10 * 1024 * 1024, "jpg": 2 * 1024 * 1024, "jpeg": 2 * 1024 * 1024, "png": 2 * 1024 * 1024, "webp": 2 * 1024 * 1024}
PIXELS = (80, 4096)


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG file."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        if content[at + 1] in (0xC0, 0xC1, 0xC2):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def audit_binary_files(files: DataFrame) -> DataFrame:
    """(path, problem) of (path, content) files: extension, size, beginning, name and pixel bounds."""

    def per_batch(batches):
        for batch in batches:
            sizes = [image_size(x) if x else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] if s else None for s in sizes], pa.int32()), pa.array([s[1] if s else None for s in sizes], pa.int32())], names=["path", "content", "width", "height"])

    sized = files.select("path", "content").mapInArrow(per_batch, "path string, content binary, width int, height int")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    magic = F.create_map(*(F.lit(x) for kv in MAGIC.items() for x in kv))
    most = F.create_map(*(F.lit(x) for kv in MAX_BYTES.items() for x in kv))
    known = F.try_element_at(magic, ext)
    checks = F.array_compact(
        F.array(
            F.when(known.isNull(), "extension"),
            F.when(F.octet_length("content") > F.try_element_at(most, ext), "too large"),
            F.when(known.isNotNull() & ~F.hex(F.substring("content", 1, 16)).startswith(known), "disguised"),
            F.when(~name.rlike(FILE_NAME_PATTERN), "name"),
            F.when((F.least("width", "height") < PIXELS[0]) | (F.greatest("width", "height") > PIXELS[1]), "dimensions"),
        )
    )
    return sized.select("path", F.explode(checks).alias("problem"))

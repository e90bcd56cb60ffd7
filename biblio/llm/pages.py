"""Operator 5: main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words score positive, tags negative.  The weight of a tag (its name and its class, its id
without digits, or its role, whichever costs most; else its name and direction) comes from labelled pages, those that mark their content with ``article`` or
``main``: the more a tag occurs outside of the marked part (elements around that part aside), the more it costs;
tags without a class, which any part of a page may have, cost ``PLAIN_MOST`` at most.  A linear scan finds the
contiguous region with the highest score.  Within it, elements with a class that hardly ever occurs in marked
content are left out, as are the elements that HTML itself sets apart from content (``SKIPPED``, an article within an article) and
blocks that say to hold readers' comments (``READERS``), and blocks of text are joined.

Weights are learned from a bounded sample (``TRAIN_PAGES``); every page is extracted, whole, in time that grows with
its length.

Defined cases: null or empty html gives empty text; a page without words gives empty text; equal scores
take the earlier region; paragraphs, list items, table cells and the like end where HTML lets them end without a tag, other
unclosed elements with the page, but a ``noscript`` or ``template`` that never ends hides nothing; a ``<`` that opens no tag is text; very long pages are pages like any other; without
labelled pages all tags cost ``UNSEEN``; repeated rows are extracted alike; an empty table gives an empty result; columns
with the names of new ones are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, with_arrays

TRAIN_PAGES = 2_000
WORD = 1.0
UNSEEN = 2.0
#: What a tag costs that occurs outside of content only; a passage of that many words outweighs it.
MOST = 60.0
#: The same for a tag without class, id or role.
PLAIN_MOST = 5.0
#: Elements that never hold article text.
SKIPPED = frozenset("script style noscript template nav aside footer form button select option textarea iframe svg head title dialog menu".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = ("article", "main")

#: Elements that end without a tag: which tags end them, and which open elements these do not look through.
_PARAGRAPH_ENDS = BLOCKS - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
_CELL_ENDS = frozenset(("td", "th", "tr", "tbody", "tfoot", "thead"))
_ENDED_BY = {
    "p": (_PARAGRAPH_ENDS, frozenset(("table", "td", "th", "caption", "button"))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "td": (_CELL_ENDS, frozenset(("table",))),
    "th": (_CELL_ENDS, frozenset(("table",))),
    "tr": (frozenset(("tr", "tbody", "tfoot", "thead")), frozenset(("table",))),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
_ENDS: dict[str, list[str]] = {}
for _name, (_tags, _) in _ENDED_BY.items():
    for _tag in _tags:
        _ENDS.setdefault(_tag, []).append(_name)

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style")}
_NAMED = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_NAME_WORDS = re.compile(r"[a-z]+")
#: Elements whose content is lost only if they end: a page may leave them open.
_MAY_END = ("noscript", "template")
#: Words in the class, id or item property of the blocks that hold what readers say.
READERS = frozenset(("comment", "comments", "commentlist", "respond", "replies"))
_SPACE = re.compile(r"\s+")


def tag_end(page: str, at: int, stop: int) -> int:
    """Place of the ``>`` that ends a tag, quoted values aside, before ``stop``; -1 if there is none."""
    while at < stop:
        at = _PLAIN.match(page, at, stop).end()
        if at >= stop:
            return -1
        if page[at] == ">":
            return at
        at = page.find(page[at], at + 1, stop) + 1
        if not at:
            return -1
    return -1


def tokens(page: str):
    """(kind, name, keys, words) of each tag ('<' or '>') and ('t', '', (), text) of each run of text of a page.

    The keys of a tag are one for each of its class, id without digits, and role, or its name where it has none of these.

    One tag that quotes keep from ending makes the rest of the page be read by a stricter rule, under which quoted values
    hold no ``<``, so that no part is looked at over and over.
    """
    at, text_from, strict, n = 0, 0, False, len(page)
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        name = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = n if end < 0 else end + 1
        else:
            m = _NAME.match(page, at + 1)
            end = 0
            if m:
                stop = n
                if not strict:
                    end = tag_end(page, m.end(), n) + 1
                    strict = not end
                if strict:
                    stop = page.find("<", m.end())
                    stop = n if stop < 0 else stop
                    end = (tag_end(page, m.end(), stop) + 1) or (page.find(">", m.end(), stop) + 1)
            if not end:  # no tag: text
                at += 1
                continue
            name, opens, inner = m[1].lower(), page[at + 1] != "/", page[m.end() : end - 1]
        if at > text_from:
            yield "t", "", (), page[text_from:at]
        if name:
            raw = _RAW.get(name) if opens else None
            if raw:  # what stands in it is no content
                m = raw.search(page, end)
                end = n if m is None else m.end()
            else:
                keys, words = [], ""
                for attr, x, y, z in _NAMED.findall(inner) if "=" in inner else ():
                    said = " ".join(_DIGITS.sub("", (x or y or z).lower()).split())
                    if said:
                        keys.append(f"{name}.{attr.lower()}={said}")
                        words += f" {said}" if attr.lower() != "role" else ""
                yield ("<" if opens else ">"), name, tuple(keys) or (("" if opens else "/") + name,), words
        at = text_from = end
    if text_from < n:
        yield "t", "", (), page[text_from:]


class Open:
    """The open elements at a place of a page."""

    def __init__(self):
        self.stack: list[tuple[str, object]] = []  # name and what is known of the element
        self.count: Counter = Counter()

    def push(self, name: str, mark) -> None:
        self.stack.append((name, mark))
        self.count[name] += 1

    def pop_to(self, size: int) -> list:
        gone = self.stack[size:]
        del self.stack[size:]
        for name, _ in gone:
            self.count[name] -= 1
        return gone

    def before(self, name: str) -> list:
        """Elements that end where a tag of this name opens."""
        gone = []
        for ended in _ENDS.get(name, ()):
            if self.count[ended]:
                walls = _ENDED_BY[ended][1]
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == ended:
                        gone += self.pop_to(k)
                        break
                    if self.stack[k][0] in walls:
                        break
        return gone

    def close(self, name: str) -> list:
        """Elements that an end tag ends; none if it ends nothing."""
        if not self.count[name]:
            return []
        k = len(self.stack) - 1
        while self.stack[k][0] != name:
            k -= 1
        return self.pop_to(k)


def tag_counts(page: str) -> tuple[Counter, Counter] | None:
    """How often each tag occurs in and out of a page's marked content; None if nothing is marked.

    Tags of elements around the marked content count on neither side.
    """
    inside, outside, depth, seen = Counter(), Counter(), 0, False
    open_ = Open()
    for kind, name, keys, _ in tokens(page):
        if kind == "t":
            continue
        if name in MARKED:
            if kind == "<" and not depth:
                for _, own in open_.stack:
                    if own[0]:  # around the content
                        outside.subtract(own[0])
                        own[0] = ()
            depth = max(0, depth + (1 if kind == "<" else -1))
            seen = True
        elif depth:
            inside.update(keys)
        elif kind == "<":
            open_.before(name)
            outside.update(keys)
            if name not in VOID:
                open_.push(name, [keys])
        else:
            gone = open_.close(name)
            if gone and gone[0][1][0]:
                outside.update(keys)
    return (inside, +outside) if seen else None


def weigh(inside: Counter, outside: Counter) -> dict[str, float]:
    """Cost of each tag: nearly nothing where it is mostly content, up to ``MOST`` where it never is."""
    out = {}
    for key in inside.keys() | outside.keys():
        most = MOST if "." in key else PLAIN_MOST
        share = (outside[key] + 0.5) / (inside[key] + outside[key] + 1.0)
        out[key] = min(most, 0.1 + max(0.0, 6.0 * math.log(share / (1 - share)))) if share > 0.5 else 0.1
        if not inside[key] and outside[key] >= 5:
            out[key] = most
    return out


def learn(pages: DataFrame, html: str = "html", most: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from about ``most`` labelled pages, drawn by a hash of the html."""
    marked = pages.select(F.col(html).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    rate = most / max(marked.count(), 1)
    sample = marked.filter(F.pmod(F.xxhash64(F.lit(5), "html"), F.lit(1 << 30)) < int(min(rate, 1.0) * (1 << 30)))

    def per_partition(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                got = tag_counts(page)
                if got:
                    inside.update(got[0])
                    outside.update(got[1])
        keys = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["key", "inside", "outside"])

    counts = sample.select("html").mapInArrow(per_partition, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return weigh(Counter({r["key"]: r["i"] for r in counts}), Counter({r["key"]: r["o"] for r in counts}))


def cost_of(keys: tuple, cost: dict[str, float], unknown: float) -> float:
    """What a tag costs: as much as the dearest of its keys that are known."""
    return max((cost[k] for k in keys if k in cost), default=unknown)


def of_readers(name: str, words: str) -> bool:
    """Whether an element is a block that holds what readers say."""
    return name in BLOCKS and not READERS.isdisjoint(_NAME_WORDS.findall(words))


def furniture(name: str, keys: tuple, words: str, cost: dict[str, float]) -> bool:
    """Whether an element is left out of the content it stands in."""
    if name in SKIPPED or name == "header" and cost_of(keys, cost, 0.0) >= PLAIN_MOST:
        return True
    return of_readers(name, words) or name not in MARKED and cost_of(keys, cost, 0.0) >= MOST


def left_out(items: list[tuple], cost: dict[str, float]) -> list[int]:
    """For each item, how many open elements around it are left out (a tag of such an element is in it).

    An article within an article is what readers add to it, as HTML has it.
    """
    ends = Counter(name for kind, name, *_ in items if kind == ">" and name in _MAY_END)
    open_, off, out = Open(), 0, []
    for kind, name, keys, words in items:
        if kind == "<":
            off -= sum(mark for _, mark in open_.before(name))
            mark = furniture(name, keys, words, cost) or name == "article" and open_.count[name] > 0
            if name in _MAY_END and ends[name] <= open_.count[name]:  # it never ends
                mark = False
            out.append(off + mark)
            if name not in VOID:
                open_.push(name, mark)
                off += mark
        else:
            out.append(off)
            if kind == ">":
                ends[name] -= 1
                off -= sum(mark for _, mark in open_.close(name))
    return out


def region(items: list[tuple], off: list[int], cost: dict[str, float]) -> tuple[int, int]:
    """First and last item of the contiguous run with the highest score (a linear scan)."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, name, keys, text) in enumerate(items):
        if kind == "t":
            value = 0.0 if off[i] else WORD * len(text.split())
        else:
            value = 0.0 if name in MARKED else -cost_of(keys, cost, UNSEEN)
        if run <= 0:
            run, start = 0.0, i
        run += value
        if run > best:
            best, best_at = run, (start, i + 1)
    return best_at


def main_text(page: str | None, cost: dict[str, float]) -> str:
    """The page's main text, one block a line."""
    if not page:
        return ""
    items = list(tokens(page))
    off = left_out(items, cost)
    first, last = region(items, off, cost)
    blocks, parts = [], []

    def close():
        block = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if block:
            blocks.append(block)
        parts.clear()

    for (kind, name, _, text), out in zip(items[first:last], off[first:last], strict=True):
        if kind == "t":
            if not out:
                parts.append(text)
        elif name in BLOCKS or (out and name in SKIPPED):
            close()
        elif name == "br" and not out:
            parts.append(" ")
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, cost: dict[str, float], html: str = "html") -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars``."""

    def compute(htmls: pa.Array):
        texts = [main_text(x, cost) for x in htmls.to_pylist()]
        return pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())

    return with_arrays(pages, compute, "text string, n_chars long", [html])


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).drop("html")

"""Texts of reports: search, sections, paging, parts, HTML to text and tables to Markdown."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, hits): matches of a case-insensitive pattern in each text; texts without any are left out."""
    return docs.select("id", F.regexp_count("text", F.lit(f"(?i){pattern}")).cast("long").alias("hits")).filter("hits > 0")


def search(docs: DataFrame, pattern: str, limit: int = 10, window: int = 300) -> DataFrame:
    """(id, total, place, start, end, snippet): the first `limit` hits of each text (positions are code points, from 0), total of all."""
    limit, window = max(1, min(limit, 25)), max(0, min(window, 1500))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(pattern, re.IGNORECASE)
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                hits = [m.span() for m in find.finditer(t or "")]
                out += [(i, len(hits), n, a, b, t[max(0, a - window) : b + window]) for n, (a, b) in enumerate(hits[:limit], 1)]
            yield pd.DataFrame(out, columns=["id", "total", "place", "start", "end", "snippet"])

    return docs.select("id", "text").mapInPandas(run, "id long, total long, place int, start long, end long, snippet string")


def term_counts(docs: DataFrame, terms: list[str], most: int = 8) -> DataFrame:
    """(term, n): how often each term of three letters or more begins a word, over all texts."""
    words = list(dict.fromkeys(t.lower() for t in terms if re.fullmatch(r"[A-Za-z]{3,}", t)))[:most]
    counts = docs.select(*[F.regexp_count("text", F.lit(rf"(?i)\b{w}")).cast("long").alias(w) for w in words])
    sums = counts.agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in words])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(w).alias("term"), F.col(w).alias("n")) for w in words])))


def hit_offsets(docs: DataFrame, word: str) -> DataFrame:
    """(id, at): positions, from 0, of a literal word, case-insensitive: the lengths of what stands before each, by splitting."""
    parts = F.split(F.lower("text"), f"\\Q{word.lower()}\\E", -1)
    sizes = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    each = docs.filter("text IS NOT NULL").select("id", F.posexplode(sizes).alias("i", "before"))
    run = F.sum("before").over(W.partitionBy("id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return each.select("id", (run + F.col("i") * len(word)).alias("at"))


def line_sections(docs: DataFrame) -> DataFrame:
    """(id, section, start, end): the lines of each text as sections."""
    each = docs.filter("text IS NOT NULL").select("id", F.posexplode(F.split("text", "\n", -1)).alias("section", "line"))
    n = F.length("line") + 1
    end = F.sum(n).over(W.partitionBy("id").orderBy("section").rowsBetween(W.unboundedPreceding, 0))
    return each.select("id", "section", (end - n).alias("start"), end.alias("end"))


def innermost_section(sections: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, at, section): the section of latest start that holds each position, the last of equal starts. An equi-join by id with a range."""
    inside = hits.join(sections, "id").filter((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")))
    best = W.partitionBy("id", "at").orderBy(F.desc("start"), F.desc("section"))
    return inside.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("id", "at", "section")


def hits_by_section(sections: DataFrame, hits: DataFrame, top: int = 10) -> DataFrame:
    """(id, section, hits, sections): busiest sections of each text and in how many sections it has hits."""
    n = innermost_section(sections, hits).groupBy("id", "section").agg(F.count(F.lit(1)).alias("hits"))
    order = W.partitionBy("id").orderBy(F.desc("hits"), "section")
    out = n.withColumns({"_n": F.row_number().over(order), "sections": F.count(F.lit(1)).over(W.partitionBy("id"))})
    return out.filter(F.col("_n") <= top).select("id", "section", "hits", "sections")


def assembly_offsets(blocks: DataFrame) -> DataFrame:
    """(id, place, start, chars) of blocks(id, place, label, text) put together as headed sections: `## label`, empty line, text, empty line."""
    head = F.length(F.coalesce("label", F.lit(""))) + 5
    size = head + F.length(F.coalesce("text", F.lit(""))) + 2
    before = F.sum(size).over(W.partitionBy("id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return blocks.select("id", "place", (F.coalesce(before, F.lit(0)) + head).alias("start"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


def assemble(blocks: DataFrame) -> DataFrame:
    """(id, text): the sections of assembly_offsets as one text."""
    part = F.struct("place", F.concat(F.lit("## "), F.coalesce("label", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("t"))
    return blocks.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "").alias("text"))


def read_page(docs: DataFrame, offset: int, size: int) -> DataFrame:
    """(id, page, chars, next_offset) of texts longer than offset (from 0); next_offset is null at the end."""
    n = F.length("text")
    return docs.filter(n > offset).select("id", F.substring("text", offset + 1, size).alias("page"), n.alias("chars"), F.when(n > offset + size, offset + size).alias("next_offset"))


#: Marks after which a text may be cut, best first: an empty line, a line's end, a sentence's end.
CUT_MARKS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s"))


def cut_near(text: str, wanted: int, low: int, high: int) -> int:
    """The end of the mark nearest to wanted within low..high, of the best kind that occurs there; wanted itself if none does."""
    for mark in CUT_MARKS if low < high else ():
        ends = [m.end() for m in mark.finditer(text, low, high)]
        if ends:
            return min(ends, key=lambda end: abs(end - wanted))
    return wanted


def parts_of(text: str, size: int | None) -> list[str]:
    """ceil(length / size) about equal parts, cut within a quarter of a part of their equal places; white space at cuts and ends is dropped, empty parts too."""
    if not size or size < 0 or len(text) <= size:
        return [text]
    n = math.ceil(len(text) / size)
    mean = len(text) / n
    cuts = [0]
    for i in range(1, n):
        wanted, reach = round(i * mean), int(mean / 4)
        cuts.append(cut_near(text, wanted, max(cuts[-1] + 1, wanted - reach), min(len(text) - 1, wanted + reach)))
    return [p for p in (text[a:b].strip() for a, b in pairwise([*cuts, len(text)])) if p]


def split_parts(docs: DataFrame, size: int) -> DataFrame:
    """(id, part from 1, parts, chars, text): balanced parts of each text, see parts_of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                parts = parts_of(t or "", size)
                out += [(i, n, len(parts), len(p), p) for n, p in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=["id", "part", "parts", "chars", "text"])

    return docs.select("id", "text").mapInPandas(run, "id long, part int, parts int, chars int, text string")


#: Elements that end a line, and those whose text is none.
BREAKS = {"p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "ul", "ol", "header", "footer", "title"}
HIDDEN = {"script", "style", "ix:header", "head-data"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BREAKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def plain_text(html: str | None) -> str:
    """The readable text of an HTML document: hidden elements dropped, block elements on lines of their own, cells parted by tabs."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.out).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \r\f]+", " ", text))).strip()


class _Tables(HTMLParser):
    """Rows of the outermost tables: (text, colspan) cells; nested tables count as text of their cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int]]]] = []
        self.depth, self.cell, self.span = 0, None, 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            value = dict(attrs).get("colspan") or "1"
            self.cell, self.span = [], min(50, int(value)) if value.isdigit() and int(value) else 1

    def _close(self):
        if self.cell is not None and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), self.span))
        self.cell = None

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def _joined_cells(row: list[str]) -> list[str]:
    """Currency signs and opening brackets join the next cell, closing brackets and percent signs the one before; places stay."""
    out = list(row)
    for i, x in enumerate(out):
        if x in ("$", "€", "£", "(", "$(") and i + 1 < len(out) and out[i + 1]:
            out[i + 1], out[i] = x + out[i + 1], ""
    for i in range(len(out) - 1, 0, -1):
        if out[i] in (")", "%", ")%"):
            j = next((j for j in range(i - 1, -1, -1) if out[j]), None)
            if j is not None:
                out[j], out[i] = out[j] + out[i], ""
    return out


def tables_markdown(html: str | None) -> list[str]:
    """Data tables of an HTML text as Markdown; tables without two columns and two rows of content are layout and left out."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for table in parser.tables:
        rows = [_joined_cells([c for text, span in row for c in [text, *[""] * (span - 1)]]) for row in table]
        width = max((len(r) for r in rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in rows if any(r)]
        used = [i for i in range(width) if any(r[i] for r in rows)]
        rows = [[r[i] for i in used] for r in rows]
        # A column of data beside an empty head moves under the head to its left.
        keep = [i for i in range(len(used)) if not (i and rows and not rows[0][i] and all(not r[i] or not r[i - 1] for r in rows[1:]))]
        for i in range(len(used) - 1, 0, -1):
            if i not in keep:
                for r in rows[1:]:
                    r[i - 1] = r[i - 1] or r[i]
        rows = [[r[i] for i in keep] for r in rows]
        if len(rows) < 2 or len(keep) < 2:
            continue
        lines = ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(keep)]
        lines += ["| " + " | ".join(c.replace("|", r"\|") for c in r) + " |" for r in rows[1:]]
        out.append("\n".join(lines))
    return out


def html_to_text(pages: DataFrame) -> DataFrame:
    """(id, text) of pages(id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [plain_text(h) for h in batch["html"]]})

    return pages.select("id", "html").mapInPandas(run, "id long, text string")


def tables_to_markdown(pages: DataFrame) -> DataFrame:
    """(id, place from 1, markdown) of the data tables of pages(id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, n, t) for i, h in zip(batch["id"], batch["html"], strict=True) for n, t in enumerate(tables_markdown(h), 1)]
            yield pd.DataFrame(out, columns=["id", "place", "markdown"])

    return pages.select("id", "html").mapInPandas(run, "id long, place int, markdown string")


def strip_block(html: str | None) -> str:
    """The text of a tagged block: its tables as Markdown, tags gone, entities read."""
    text = html or ""
    for table, md in zip(re.findall(r"(?is)<table\b.*?</table>", text), tables_markdown(text), strict=False):
        text = text.replace(table, f"\n\n{md}\n\n", 1)
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
    text = re.sub(r"(?i)</?(p|div|br|tr|li|h[1-6]|table)\b[^>]*>", "\n", text)
    text = unescape(re.sub(r"<[^>]+>", " ", text)).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", text))).strip()


#: Item headings of the annual and quarterly report.
ITEMS = {"1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings", "5": "Market for Registrant's Common Equity", "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk", "8": "Financial Statements and Supplementary Data", "9A": "Controls and Procedures"}
_ITEM = re.compile(r"(?im)^[ \t]*item[ \t]+(\d{1,2}[A-C]?)[.:\s\-–—]+([^\n]{0,120})$")


def item_sections(text: str | None) -> list[tuple[str, int, int]]:
    """(item, start, end) of the Items of a narrative: headings that are no contents entries; of several candidates the longest, the earliest of equals."""
    found = [(m.group(1).upper(), m.start(), m.end()) for m in _ITEM.finditer(text or "") if not re.search(r"\.{3,}|\s\d{1,3}\s*$", m.group(2))]
    best: dict[str, tuple[int, int]] = {}
    for (item, a, head), after in zip(found, [*(f[1] for f in found[1:]), len(text or "")], strict=True):
        if after - head < 40:  # a heading right before the next is a contents entry
            continue
        if item not in best or after - a > best[item][1] - best[item][0]:
            best[item] = (a, after)
    return sorted(((i, a, b) for i, (a, b) in best.items()), key=lambda s: s[1])


def extract_items(docs: DataFrame) -> DataFrame:
    """(id, item, caption, start, end, text) of the Items of docs(id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, item, ITEMS.get(item), a, b, t[a:b]) for i, t in zip(batch["id"], batch["text"], strict=True) for item, a, b in item_sections(t)]
            yield pd.DataFrame(out, columns=["id", "item", "caption", "start", "end", "text"])

    return docs.select("id", "text").mapInPandas(run, "id long, item string, caption string, start long, end long, text string")


class _Inline(HTMLParser):
    """Text blocks of inline documents with their continuations; excluded passages dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, str]] = []
        self.parts: dict[str, list[str]] = {}
        self.heads: list[tuple[str, str]] = []
        self.next: dict[str, str] = {}
        self.excluded = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "ix:exclude":
            self.excluded += 1
        elif tag in ("ix:nonnumeric", "ix:continuation"):
            key = a.get("id") or f"#{len(self.parts)}"
            if tag == "ix:nonnumeric":
                self.heads.append((a.get("name", ""), key))
            if a.get("continuedat"):
                self.next[key] = a["continuedat"]
            self.parts[key] = []
            self.open.append((tag, key))
        else:
            self._add(self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        if tag == "ix:exclude":
            self.excluded = max(0, self.excluded - 1)
        elif tag in ("ix:nonnumeric", "ix:continuation"):
            if self.open:
                self.open.pop()
        else:
            self._add(f"</{tag}>")

    def _add(self, raw: str) -> None:
        if not self.excluded:
            for _, key in self.open:
                self.parts[key].append(raw)

    def handle_data(self, data):
        self._add(data)

    def handle_entityref(self, name):
        self._add(f"&{name};")

    def handle_charref(self, name):
        self._add(f"&#{name};")


def inline_blocks(html: str | None) -> list[tuple[str, str]]:
    """(name, text) of the inline text facts; chains of continuations are followed once each, equal texts of one name kept once."""
    parser = _Inline()
    parser.feed(html or "")
    parser.close()
    out: dict[tuple[str, str], None] = {}
    for name, key in parser.heads:
        parts, seen, at = [], set(), key
        while at and at not in seen:
            seen.add(at)
            parts += parser.parts.get(at, [])
            at = parser.next.get(at)
        out[(name, strip_block("".join(parts)))] = None
    return list(out)


def extract_inline_blocks(pages: DataFrame) -> DataFrame:
    """(id, place, name, text) of the inline text blocks of pages(id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, n, name, t) for i, h in zip(batch["id"], batch["html"], strict=True) for n, (name, t) in enumerate(inline_blocks(h), 1)]
            yield pd.DataFrame(out, columns=["id", "place", "name", "text"])

    return pages.select("id", "html").mapInPandas(run, "id long, place int, name string, text string")

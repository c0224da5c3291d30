"""Content extraction from crawled pages: tables, selector matches, type routing.

The standard library's HTML tokenizer runs inside Arrow map tasks, one page at a
time; everything after it (cleaning, validation, records) is Column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Collection, Iterator, Mapping
from functools import partial
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import clean_text
from gleanery.functions.values import as_number

MIN_TABLE_ROWS = 1
MAX_TABLE_ROWS = 10_000
#: Characters of pages whose results are laid out together.
CHUNK = 8 << 20

# Fixed values from the HTML standard: elements without content, the elements an
# opening tag closes, and the containers such a search stops at.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"td", "th", "tr"},
    "thead": {"td", "th", "tr", "thead", "tbody", "tfoot"},
    "tbody": {"td", "th", "tr", "thead", "tbody", "tfoot"},
    "tfoot": {"td", "th", "tr", "thead", "tbody", "tfoot"},
}
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SCOPES = frozenset(("table", "ul", "ol", "dl", "select"))
RAW_TEXT = frozenset(("script", "style"))
ENDS = {tag: CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_PARAGRAPH else set()) for tag in CLOSES_PARAGRAPH | set(CLOSED_BY)}
#: Elements in which markup may not be read as such; the first ones' text is read as any other's, or not at all.
ONE_TEXT = frozenset("script style textarea title".split())
UNPARSED = frozenset("plaintext xmp iframe noembed noframes noscript".split())
#: Text and then a tag whose attributes, if any, are all quoted and free of references; a short comment; a document type.
PLAIN_TAG = re.compile(
    r"""([^<]*)(?:<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*[ \n]*/?)>|<!--[^<>!&-]+(?:-[^<>!&-]+)*-->|<!(?:doctype|DOCTYPE) [a-zA-Z]+>)"""
)
PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)\"""")


class _Span:
    """Where an element's text begins and ends."""

    __slots__ = ("start", "end")


class _Tree(HTMLParser):
    """Follows the open elements of a page, closing the ones the author left open.

    Text is kept once, in order; an element that is wanted has a :class:`_Span` of it. So
    a piece of text costs the same however many elements are open round it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, _Span | None]] = []
        self.texts: list[str] = []
        self.tags: dict[str, list[int]] = {}

    def opened(self, tag: str, attrs: dict[str, str | None]) -> _Span | None:
        return None

    def closed(self, tag: str) -> None:
        pass

    def text_of(self, span: _Span) -> str:
        texts = self.texts[span.start : span.end]
        return texts[0] if len(texts) == 1 else "".join(texts)

    def _pop_to(self, depth: int) -> None:
        open_, tags, place, closed = self.open, self.tags, len(self.texts), self.closed
        while len(open_) > depth:
            tag, span = open_.pop()
            tags[tag].pop()
            if span is not None:
                span.end = place
            closed(tag)

    def _deepest(self, tags: Collection[str]) -> int:
        """The place of the innermost open element among ``tags``, or -1."""
        deepest = -1
        for t in tags:
            at = self.tags.get(t)
            if at and at[-1] > deepest:
                deepest = at[-1]
        return deepest

    def _imply_end(self, tag: str) -> None:
        tags = self.tags
        open_ = [at for t in ENDS.get(tag, ()) if (at := tags.get(t))]
        if open_:
            scope = self._deepest(SCOPES)
            inside = [at[bisect_right(at, scope)] for at in open_ if at[-1] > scope]
            if inside:
                self._pop_to(min(inside))

    def handle_starttag(self, tag, attrs):
        self._imply_end(tag)
        self._open(tag, dict(attrs))

    def _open(self, tag: str, attrs: dict[str, str | None]) -> None:
        span = self.opened(tag, attrs)
        if span is not None:
            span.start = span.end = len(self.texts)
        if tag in VOID_TAGS:
            self.closed(tag)
        else:
            self.tags.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, span))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self._deepest((tag,))
        # The end of a cell or row does not reach out of its table.
        if at >= 0 and not (tag in CLOSED_BY and self._deepest(("table",)) > at):
            self._pop_to(at)

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in RAW_TEXT):
            self.texts.append(data)

    def _plain(self, html: str) -> int:
        """Take the page's markup as far as it is plain; the place where it is not.

        Plain markup (:data:`PLAIN_TAG`) means the same to every reader of HTML. What an
        author got wrong, and anything rare, is left to the standard library's parser,
        which takes many times as long for a tag.
        """
        at, match = 0, PLAIN_TAG.match
        while found := match(html, at):
            data, end, tag, attrs = found.groups()
            if tag:
                tag = tag.lower()
                if end and attrs or tag in UNPARSED:
                    break
                if tag in ONE_TEXT and not end:
                    # Its content must be one text up to its own end.
                    closing = match(html, found.end())
                    if closing is None or not closing[2] or closing[3].lower() != tag or attrs.endswith("/"):
                        break
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            at = found.end()
            if end:
                self.handle_endtag(tag)
            elif tag:
                if tag in ENDS:
                    self._imply_end(tag)
                self._open(tag, {k.lower(): v for k, v in PLAIN_ATTRIBUTE.findall(attrs)} if attrs else {})
        return at

    def run(self, html: str):
        self.feed(html[self._plain(html) :])
        self.close()
        self._pop_to(0)
        return self


class _Tables(_Tree):
    """Collects every table of a page as (header rows, body rows) of cell texts."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.stack: list[dict] = []

    def opened(self, tag, attrs):
        if tag == "table":
            table = {"rows": [], "cells": None, "head": False}
            self.tables.append(table)
            self.stack.append(table)
        elif self.stack:
            table = self.stack[-1]
            if tag == "thead":
                table["head"] = True
            elif tag == "tr":
                table["cells"] = []
            elif tag in ("td", "th"):
                if table["cells"] is None:
                    table["cells"] = []
                cols, rows = (_span(attrs.get("colspan"), MOST_COLUMNS), _span(attrs.get("rowspan"), MOST_ROWS)) if attrs else (1, 1)
                cell = {"span": _Span(), "th": tag == "th", "cols": cols, "rows": rows}
                table["cells"].append(cell)
                return cell["span"]
        return None

    def closed(self, tag):
        if not self.stack:
            return
        table = self.stack[-1]
        if tag in ("tr", "table") and table["cells"] is not None:
            table["rows"].append((table["head"], table["cells"]))
            table["cells"] = None
        if tag == "thead":
            table["head"] = False
        elif tag == "table":
            self.stack.pop()



# The most columns and rows that a cell may span in HTML. Rows are filled
# only as far as the table goes.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


def _span(value: str | None, most: int) -> int:
    return max(1, min(int(value), most)) if value and value.isdigit() else 1


def _cell_text(page: _Tables, cell: dict) -> str | None:
    text = page.text_of(cell["span"])
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).strip() or None


def _grid(page: _Tables, table: dict) -> tuple[list[str], list[list[str | None]]]:
    """(column names, body rows), with row and column spans written out."""
    pending: dict[int, tuple[int, str | None]] = {}
    lines = []
    for in_head, cells in table["rows"]:
        if not pending and not any(c["cols"] > 1 or c["rows"] > 1 for c in cells):
            if cells:
                lines.append((in_head or all(c["th"] for c in cells), [_cell_text(page, c) for c in cells]))
            continue
        line: list[str | None] = []

        def carry() -> None:
            while len(line) in pending:
                left, text = pending.pop(len(line))
                if left > 1:
                    carried[len(line)] = (left - 1, text)
                line.append(text)

        carried: dict[int, tuple[int, str | None]] = {}
        for cell in cells:
            carry()
            text = _cell_text(page, cell)
            for _ in range(cell["cols"]):
                if cell["rows"] > 1:
                    carried[len(line)] = (cell["rows"] - 1, text)
                line.append(text)
        carry()
        pending = carried
        if line:
            lines.append((in_head or all(c["th"] for c in cells), line))
    headers = []
    while lines and lines[0][0]:
        headers.append(lines.pop(0)[1])
    width = max((len(line) for line in headers + [x for _, x in lines]), default=0)
    names = [" ".join(h[i] for h in headers if i < len(h) and h[i]) or (f"Unnamed: {i}" if headers else str(i)) for i in range(width)]
    return names, [line + [None] * (width - len(line)) for _, line in lines]


_TEXT_LIST = pa.list_(pa.string())
TABLES = {"page_id": ("string", pa.string()), "table_idx": ("int", pa.int32()), "names": ("array<string>", _TEXT_LIST), "rows": ("array<array<string>>", pa.list_(_TEXT_LIST))}
MATCHES = {"page_id": ("string", pa.string()), "name": ("string", pa.string()), "match_idx": ("int", pa.int32()), "value": ("string", pa.string())}


def _map_pages(pages: DataFrame, id_col: str, html_col: str, parse: Callable[[str, str], list[tuple]], schema: Mapping[str, tuple]) -> DataFrame:
    """Rows of ``parse(page_id, html)`` for every page, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def laid_out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, schema.values())]
            return pa.RecordBatch.from_arrays(arrays, names=list(schema))

        for batch in batches:
            rows, held = [], 0
            for page, html in zip(*batch.columns):
                source = html.as_py() or ""
                rows += parse(page.as_py(), source)
                held += len(source)
                if held > CHUNK:
                    yield laid_out(rows)
                    rows, held = [], 0
            yield laid_out(rows)

    slim = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in schema.items()))


def _tables_of(page: str, html: str) -> list[tuple]:
    tree = _Tables().run(html)
    return [(page, i, *_grid(tree, table)) for i, table in enumerate(tree.tables)] or [(page, None, None, None)]


def scan_tables(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row per ``<table>``: cleaned column names and rows of cells, empty cells null.

    A page without tables gives one row without ``table_idx``. A table is part
    of one page's text, so a row is never larger than a page.
    """
    raw = _map_pages(pages, id_col, html_col, _tables_of, TABLES)

    def tidy(cells: Column) -> Column:
        return F.transform(cells, lambda x: F.when(x.isNotNull(), clean_text(x, normalised=True)))

    return raw.withColumns({"names": tidy(F.col("names")), "rows": F.transform("rows", tidy)})


def table_records(tables: DataFrame) -> DataFrame:
    """``(page_id, table_idx, row_idx, record map)`` of the tables, or of the valid ones once judged."""
    wanted = F.when(F.col("valid"), F.col("rows")) if "valid" in tables.columns else F.col("rows")
    # Filtering before the explode would be pushed below the cleaning and repeat
    # it; a rejected table explodes to a null row instead.
    rows = tables.select("page_id", "table_idx", "names", F.posexplode_outer(wanted).alias("row_idx", "cells"))
    return rows.filter(F.col("row_idx").isNotNull()).select(
        "page_id", "table_idx", "row_idx", F.map_from_arrays("names", "cells").alias("record")
    )


def pages_without_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(F.col("table_idx").isNull()).select("page_id", F.lit("No tables found").alias("error"))


def validate_tables(tables: DataFrame, min_rows: int = MIN_TABLE_ROWS, max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """Add ``row_count``, ``valid`` and ``problem`` to each table, within its row.

    Checked in this order: row count, duplicate names, columns without a value,
    columns where some values read as numbers and others do not.
    """
    rows = F.col("rows")

    def some_column(test: Callable[[Column], Column]) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size("names") - 1), test)

    def is_empty(i: Column) -> Column:
        return F.forall(rows, lambda r: r[i].isNull())

    def is_mixed(i: Column) -> Column:
        number = F.exists(rows, lambda r: as_number(r[i]).isNotNull())
        return number & F.exists(rows, lambda r: r[i].isNotNull() & r[i].try_cast("double").isNull())

    count = F.size(rows)
    problem = (
        F.when(count < min_rows, F.lit("too few rows"))
        .when(count > max_rows, F.lit("too many rows"))
        .when(F.size(F.array_distinct("names")) < F.size("names"), F.lit("duplicate column names"))
        .when(some_column(is_empty), F.lit("empty columns"))
        .when(some_column(is_mixed), F.lit("mixed data types"))
    )
    judged = tables.filter(F.col("table_idx").isNotNull()).withColumns({"row_count": count, "problem": problem})
    return judged.withColumn("valid", F.col("problem").isNull())


def extract_tables(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", min_rows: int = MIN_TABLE_ROWS, max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """Records of the valid tables; a bad table is skipped and its page goes on.

    One pass over the pages and no shuffle: a table is judged inside its row.
    """
    return table_records(validate_tables(scan_tables(pages, html_col, id_col), min_rows, max_rows))


class _Matches(_Tree):
    """Collects the text of the elements each selector matches, in document order."""

    def __init__(self, selectors: Mapping[str, str]) -> None:
        super().__init__()
        self.selectors = selectors
        self.found: list[tuple[str, _Span]] = []

    def opened(self, tag, attrs):
        classes = (attrs.get("class") or "").split()
        span = None
        for name, selector in self.selectors.items():
            if selector[0] == ".":
                hit = selector[1:] in classes
            elif selector[0] == "#":
                hit = selector[1:] == attrs.get("id")
            else:
                hit = selector.lower() == tag
            if hit:
                span = span or _Span()
                self.found.append((name, span))
        return span


def _matches_of(page: str, html: str, selectors: Mapping[str, str]) -> list[tuple]:
    seen: dict[str, int] = {}
    out = []
    tree = _Matches(selectors).run(html)
    for name, span in tree.found:
        index = seen[name] = seen.get(name, -1) + 1
        out.append((page, name, index, unicodedata.normalize("NFKC", tree.text_of(span))))
    return out


class _Links(_Tree):
    """Collects the targets of a page's links."""

    def __init__(self) -> None:
        super().__init__()
        self.targets: list[str] = []

    def opened(self, tag, attrs):
        if tag == "a" and attrs.get("href") is not None:
            self.targets.append(attrs["href"])
        return None


class PageLinks:
    """Table function over batches of ``(id, html)``: a row per link, in document order."""

    def eval(self, pages: pa.RecordBatch):
        found = [(page, target) for page, html in zip(*(c.to_pylist() for c in pages.columns)) for target in _Links().run(html or "").targets]
        ids, targets = zip(*found) if found else ((), ())
        yield pa.table({"page_id": pa.array(ids, pages.column(0).type), "target": pa.array(targets, pa.string())})


def extract_selectors(pages: DataFrame, selectors: Mapping[str, str], html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row per match of ``name -> tag | .class | #id``, its text cleaned."""
    if not selectors or not all(s and s.strip(".#") for s in selectors.values()):
        raise ValueError("selectors must map names to a tag, .class or #id")
    raw = _map_pages(pages, id_col, html_col, partial(_matches_of, selectors=dict(selectors)), MATCHES)
    return raw.withColumn("value", clean_text(F.col("value"), normalised=True))


def route_by_type(df: DataFrame, kind: str, handlers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Give each type's rows to its handler; rows of an unknown type become error rows."""
    known = F.coalesce(F.col(kind).isin(*handlers), F.lit(False))
    unknown = df.filter(~known).select(
        *df.columns, F.lit("failed").alias("status"), F.concat(F.lit("Invalid type: "), F.coalesce(F.col(kind), F.lit("null"))).alias("error")
    )
    out = unknown
    for name, handler in handlers.items():
        out = out.unionByName(handler(df.filter(F.col(kind) == name)), allowMissingColumns=True)
    return out

"""Pages to element tables: the one Python stage of extraction.

Each page becomes an array of elements in document order. An element knows its parent and its
previous sibling by position, and the position of its last descendant, so an element lies inside
another if its position lies in the other's range: any depth costs the same. It also knows its
place among its siblings. Text is kept once per page; an element holds the range of it that lies
inside.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.session import spread_small

# The tokeniser travels with its tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of HTML: elements without content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT_TAGS = frozenset(("script", "style", "template"))
# Fixed values of HTML: a start tag of the first set ends an open element of the second, unless
# an element of the third lies in between.
_BLOCKS = frozenset(
    "address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header "
    "hr main nav ol p pre section table ul".split()
)
IMPLIED_ENDS = (
    (_BLOCKS, frozenset(("p",)), frozenset("body div td th li table article section blockquote".split())),
    (frozenset(("li",)), frozenset(("li",)), frozenset(("ul", "ol"))),
    (frozenset(("dt", "dd")), frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("td", "th")), frozenset(("td", "th")), frozenset(("tr", "table"))),
    (frozenset(("tr",)), frozenset(("tr",)), frozenset(("table", "tbody", "thead", "tfoot"))),
    (frozenset(("tbody", "thead", "tfoot")), frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    (frozenset(("option",)), frozenset(("option",)), frozenset(("select",))),
)

_NODE = pa.struct(
    [
        ("pre", pa.int32()),
        ("parent", pa.int32()),
        ("prev", pa.int32()),
        ("post", pa.int32()),
        ("nth", pa.int32()),
        ("siblings", pa.int32()),
        ("nth_of_type", pa.int32()),
        ("siblings_of_type", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("classes", pa.list_(pa.string())),
        ("text_from", pa.int32()),
        ("text_to", pa.int32()),
        ("raw_text", pa.string()),
        ("html_from", pa.int32()),
        ("html_to", pa.int32()),
    ]
)

NODES_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("pre", T.IntegerType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("prev", T.IntegerType()),
            T.StructField("post", T.IntegerType()),
            T.StructField("nth", T.IntegerType()),
            T.StructField("siblings", T.IntegerType()),
            T.StructField("nth_of_type", T.IntegerType()),
            T.StructField("siblings_of_type", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("classes", T.ArrayType(T.StringType())),
            T.StructField("text_from", T.IntegerType()),
            T.StructField("text_to", T.IntegerType()),
            T.StructField("raw_text", T.StringType()),
            T.StructField("html_from", T.IntegerType()),
            T.StructField("html_to", T.IntegerType()),
        ]
    )
)


# Tags whose content or place the standard parser may read by rules of its own.
_OWN_RULES = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
# Text and the tag behind it, when neither holds an entity and the tag is written as it should be. All else is left
# to the standard parser, which reads these the same way at several times the cost.
_GAP = r"[ \t\n\r\f]"
_PLAIN = re.compile(
    rf"([^<&]*)<(?:/([a-zA-Z][a-zA-Z0-9]*){_GAP}*>"
    rf'|([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}+[a-zA-Z][a-zA-Z0-9_-]*="[^"&]*")*){_GAP}*>)'
)
_PLAIN_ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
_IMPLIED = {
    tag: [(closes, stops) for starts, closes, stops in IMPLIED_ENDS if tag in starts]
    for tag in frozenset().union(*(starts for starts, _, _ in IMPLIED_ENDS))
}


class _Shredder(HTMLParser):
    """Turns tag events of one page into elements.

    What a start tag tells is kept in ``elements``, what is known at the end of an element in lists of its own.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.at = 0
        # Parent, tag, attributes, and where text and source begin.
        self.elements: list[tuple[int, str, dict[str, str], int, int]] = []
        self.post: list[int] = []
        self.text_to: list[int] = []
        self.html_to: list[int] = []
        self.raw_text: dict[int, str] = {}
        # Open elements by position, and by tag as places in ``open``: ends are found without walking up.
        self.open: list[int] = []
        self.open_at: dict[str, list[int]] = {}
        self.pieces: list[str] = []
        self.text_size = 0
        self.pending: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        while self.open:
            self._end(len(html))

    def updatepos(self, i: int, j: int) -> int:
        """The parser tells every step here: positions add up, and no lines are counted."""
        if i < j:
            self.at += j - i
        return j

    def parse_starttag(self, i: int) -> int:
        end = self._plain(i)
        return end if end > i else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        end = self._plain(i)
        return end if end > i else super().parse_endtag(i)

    def _plain(self, i: int) -> int:
        """Handle plain tags, and plain text between them, from ``i`` on; returns where they end."""
        if self.cdata_elem is not None:
            return i
        source, before, match = self.rawdata, self.at - i, _PLAIN.match
        while found := match(source, i):
            text, ended, started, attrs = found.groups()
            tag = (started or ended).lower()
            if started and tag in _OWN_RULES:
                break
            if text:
                self.pending.append(text)
            at, i = before + found.end(1), found.end()
            if started:
                self._start(tag, _PLAIN_ATTR.findall(attrs) if attrs else (), at, before + i)
            else:
                self._close(tag, at, before + i)
        return i

    def _flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending = []
        if self.open and self.open[-1] in self.raw_text:
            self.raw_text[self.open[-1]] += text
            return
        text = text.strip()
        if text:
            self.pieces.append(text)
            self.text_size += len(text)

    def _end(self, at: int) -> None:
        place = self.open.pop() - 1
        self.open_at[self.elements[place][1]].pop()
        self.text_to[place], self.html_to[place], self.post[place] = self.text_size, at, len(self.elements)

    def _innermost(self, tags: frozenset[str]) -> int:
        """Place in ``open`` of the innermost open element with one of the tags, or -1."""
        innermost = -1
        for tag in tags:
            places = self.open_at.get(tag)
            if places and places[-1] > innermost:
                innermost = places[-1]
        return innermost

    def _start(self, tag: str, attrs: Iterable[tuple[str, str | None]], at: int, source_end: int) -> None:
        if self.pending:
            self._flush()
        for closes, stops in _IMPLIED.get(tag, ()):
            depth = self._innermost(closes)
            if depth >= 0 and depth > self._innermost(stops):
                while len(self.open) > depth:
                    self._end(at)
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name.lower(), value or "")
        self.elements.append((self.open[-1] if self.open else 0, tag, known, self.text_size, at))
        pre = len(self.elements)
        self.post.append(pre)
        self.text_to.append(self.text_size)
        self.html_to.append(source_end)
        if tag not in VOID_TAGS:
            if tag in RAW_TEXT_TAGS:
                self.raw_text[pre] = ""
            self.open_at.setdefault(tag, []).append(len(self.open))
            self.open.append(pre)

    def _close(self, tag: str, at: int, source_end: int) -> None:
        if self.pending:
            self._flush()
        places = self.open_at.get(tag)
        if places:
            depth = places[-1]
            while len(self.open) > depth + 1:
                self._end(at)
            self._end(source_end)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, self.at, self.at + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        close = self.html.find(">", self.at)
        self._close(tag, self.at, len(self.html) if close < 0 else close + 1)

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()


def _offsets(sizes: Iterable[int]) -> pa.Array:
    return pa.array([0, *itertools.accumulate(sizes)], pa.int32())


def _among(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every element its place within its group, the size of the group, and its predecessor there or -1."""
    order = np.argsort(groups, kind="stable")
    new = np.diff(groups[order], prepend=-1) != 0
    begins = np.flatnonzero(new)
    sizes = np.diff(begins, append=len(groups))
    nth, size, before = (np.empty(len(groups), np.int64) for _ in range(3))
    nth[order] = np.arange(1, len(groups) + 1) - np.repeat(begins, sizes)
    size[order] = np.repeat(sizes, sizes)
    before[order] = np.where(new, -1, np.roll(order, 1))
    return nth, size, before


def _nodes_array(pages: list[_Shredder | None]) -> pa.Array:
    """Elements of pages as one array of ``_NODE``; fields are made as columns, places among siblings for all at once."""
    found = [page for page in pages if page and page.elements]
    elements = [element for page in found for element in page.elements]
    parents, tags, attrs, text_from, html_from = zip(*elements) if elements else ((),) * 5
    counts = np.array([len(page.elements) for page in found], np.int64)
    # Positions count from 1 in each page, so a page takes one number more than it has elements.
    page_at = np.repeat(np.cumsum(counts) - counts, counts)
    pre = np.arange(1, len(elements) + 1) - page_at
    tag = pa.array(tags, pa.string())
    kind = tag.dictionary_encode()
    sibling_of = np.array(parents, np.int64) + page_at + np.repeat(np.arange(len(found)), counts)
    nth, siblings, before = _among(sibling_of)
    kinds = kind.indices.to_numpy().astype(np.int64)
    nth_of_type, siblings_of_type, _ = _among(sibling_of * max(1, len(kind.dictionary)) + kinds)
    classes = [known["class"].split() if "class" in known else () for known in attrs]
    every = itertools.chain.from_iterable
    columns = {
        "pre": pre,
        "parent": parents,
        "prev": np.where(before < 0, 0, before + 1 - page_at),
        "post": list(every(page.post for page in found)),
        "nth": nth,
        "siblings": siblings,
        "nth_of_type": nth_of_type,
        "siblings_of_type": siblings_of_type,
        "tag": tag,
        "attrs": pa.MapArray.from_arrays(
            _offsets(map(len, attrs)),
            pa.array(list(every(attrs)), pa.string()),
            pa.array(list(every(known.values() for known in attrs)), pa.string()),
        ),
        "classes": pa.ListArray.from_arrays(_offsets(map(len, classes)), pa.array(list(every(classes)), pa.string())),
        "text_from": text_from,
        "text_to": list(every(page.text_to for page in found)),
        "raw_text": [page.raw_text.get(p) for page in found for p in range(1, len(page.elements) + 1)],
        "html_from": html_from,
        "html_to": list(every(page.html_to for page in found)),
    }
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in _NODE]
    inside = _offsets(len(page.elements) if page else 0 for page in pages)
    return pa.ListArray.from_arrays(inside, pa.StructArray.from_arrays(arrays, fields=list(_NODE)))


def _text(page: _Shredder | None) -> str:
    return "".join(page.pieces) if page else ""


def shred(html: str | None) -> tuple[list[dict], str]:
    """Elements and page text of one page; a missing page has none."""
    page = _Shredder(html) if html else None
    return _nodes_array([page]).to_pylist()[0], _text(page)


def shred_html(
    df: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), keep_html: bool = True
) -> DataFrame:
    """Add ``nodes`` and ``page_text`` to the kept columns; nothing is shuffled.

    Only kept columns and the page reach Python. Output batches hold a few megabytes of pages.
    """
    source = spread_small(df.select(*keep, html_col))
    kept = [*keep, *([html_col] if keep_html else [])]
    fields = [source.schema[c] for c in kept]
    schema = T.StructType(
        [*fields, T.StructField("nodes", NODES_TYPE), T.StructField("page_text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: pa.RecordBatch, pages: list[_Shredder | None]) -> pa.RecordBatch:
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            columns += [_nodes_array(pages), pa.array(map(_text, pages), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*kept, "nodes", "page_text"])

        for batch in batches:
            sources = batch.column(batch.schema.get_field_index(html_col))
            begin, size, pages = 0, 0, []
            for row, source_text in enumerate(sources):
                html = source_text.as_py()
                pages.append(_Shredder(html) if html else None)
                size += len(html or "")
                if size > 4_000_000:
                    yield emit(batch.slice(begin, row + 1 - begin), pages)
                    begin, size, pages = row + 1, 0, []
            if pages:
                yield emit(batch.slice(begin), pages)

    return source.mapInArrow(run, schema)


def node_table(shredded: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Elements as rows, one per element."""
    return shredded.select(*keep, F.explode("nodes").alias("n")).select(*keep, "n.*")

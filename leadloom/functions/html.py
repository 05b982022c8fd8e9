"""One page to its elements: the only Python stage of the page jobs.

Runs over Arrow batches inside tasks; a page never leaves the task that reads it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql.types import IntegerType, MapType, NullType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from leadloom.functions.markup import tokens

# Element kinds that later jobs read.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT_TAGS = frozenset(("script", "style", "template"))
READ_TAGS = frozenset(
    "html title meta link a button h1 h2 h3 p nav footer header main section article div li tr details span img body".split()
)
REGION_WORDS = ("hero", "banner", "faq", "accordion")
BLOCK_TAGS = frozenset("section article div li footer p header tr".split())
URL_KEY_WORDS = ("website", "url", "href", "link")
# Blocks that later jobs read as one text: rows of openings, people, founders' lines.
BOXES = {
    "jobs": frozenset("li article div tr".split()),
    "people": frozenset("section article div li footer p header".split()),
    "bios": frozenset("p div li article section".split()),
}

# Texts are ranges over the page's pieces, so nested elements never repeat a text.
ELEMENT_TYPE = pa.struct(
    [
        ("pos", pa.int32()),
        ("last", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("first_piece", pa.int32()),
        ("pieces", pa.int32()),
        ("chars", pa.int32()),  # length of the text
        ("leaf", pa.bool_()),  # no block inside
        ("link", pa.int32()),  # place in the elements of the first anchor with a target inside
        ("around", pa.int32()),  # an anchor's surroundings: place in link_boxes
    ]
)
# Text that stands in a block itself, between the blocks inside it. The last three: length of the nearest enclosing box
# of that kind, 0 where it holds no block and so is read whole, null without one.
RUN_TYPE = pa.struct(
    [
        ("owner", pa.int32()),  # place in the elements, null where that element is not among them
        ("pos", pa.int32()),
        ("first_piece", pa.int32()),
        ("pieces", pa.int32()),
        ("chars", pa.int32()),
        ("link", pa.int32()),
        *[(kind, pa.int32()) for kind in BOXES],
    ]
)
RANGE_TYPE = pa.struct([("first_piece", pa.int32()), ("pieces", pa.int32())])
OBJECT_TYPE = pa.struct(
    [
        ("script", pa.int32()),  # place in json_ld_texts
        ("top", pa.bool_()),
        ("kinds", pa.list_(pa.string())),
        ("first", pa.int32()),
        ("chars", pa.int32()),
    ]
)
CANDIDATE_TYPE = pa.struct([("origin", pa.string()), ("script", pa.int32()), ("value", pa.string())])

PARSED_COLUMNS = [
    ("elements", pa.list_(ELEMENT_TYPE)),
    ("page_pieces", pa.list_(pa.string())),
    ("text_runs", pa.list_(RUN_TYPE)),
    ("link_boxes", pa.list_(RANGE_TYPE)),
    ("json_ld", pa.list_(OBJECT_TYPE)),
    ("json_ld_texts", pa.list_(pa.string())),
    ("json_ld_scripts", pa.list_(pa.string())),
    ("url_candidates", pa.list_(CANDIDATE_TYPE)),
    ("parse_error", pa.string()),
]

PARSED_DDL = """elements array<struct<pos:int,last:int,tag:string,attrs:map<string,string>,first_piece:int,pieces:int,chars:int,leaf:boolean,
 link:int,around:int>>, page_pieces array<string>, text_runs array<struct<owner:int,pos:int,first_piece:int,pieces:int,chars:int,link:int,jobs:int,people:int,bios:int>>,
 link_boxes array<struct<first_piece:int,pieces:int>>, json_ld array<struct<script:int,top:boolean,kinds:array<string>,first:int,chars:int>>,
 json_ld_texts array<string>, json_ld_scripts array<string>, url_candidates array<struct<origin:string,script:int,value:string>>, parse_error string"""


class _Node:
    __slots__ = ("pos", "last", "tag", "attrs", "parent", "first_string", "end_string", "leaf")

    def __init__(self, pos: int, tag: str, attrs: dict[str, str], parent: int, first_string: int) -> None:
        self.pos = pos
        self.last = pos
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.first_string = first_string
        self.end_string = first_string
        self.leaf = True


class _Outline:
    """Element outline with the range of text pieces below each element."""

    def __init__(self) -> None:
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []
        self.strings: list[str] = []
        self.scripts: list[tuple[dict[str, str], str]] = []
        self.runs: list[list[int | None]] = []  # owner, first piece, end, anchor
        self._script: list[str] | None = None
        self._silent = 0
        self._open_tags: Counter[str] = Counter()
        self._blocks: list[_Node] = []
        self._links: list[_Node] = []
        self._new_run = True

    def read(self, html: str) -> None:
        for kind, value, *rest in tokens(html):
            if kind == "start":
                self.handle_starttag(value, *rest)
            elif kind == "end":
                self.handle_endtag(value)
            else:
                self.handle_data(value)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool) -> None:
        parent = self.open[-1].pos if self.open else -1
        node = _Node(len(self.nodes), tag, {k: v or "" for k, v in attrs}, parent, len(self.strings))
        self.nodes.append(node)
        if tag in VOID_TAGS:
            return
        self.open.append(node)
        self._open_tags[tag] += 1
        if tag in BLOCK_TAGS:
            self._blocks.append(node)
            self._new_run = True
        elif tag == "a" and "href" in node.attrs:
            self._links.append(node)
        if tag in SILENT_TAGS:
            self._silent += 1
            self._script = [] if tag == "script" else self._script
        if closed:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self._open_tags[tag]:
            node = self.open.pop()
            self._shut(node)
            if node.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        if self._silent:
            if self._script is not None:
                self._script.append(data)
            return
        piece = data.strip()
        if not piece:
            return
        if self._blocks:
            if self._new_run:
                self.runs.append([self._blocks[-1].pos, len(self.strings), 0, None])
                self._new_run = False
            run = self.runs[-1]
            run[2] = len(self.strings) + 1
            if run[3] is None and self._links:
                run[3] = self._links[-1].pos
        self.strings.append(piece)

    def _shut(self, node: _Node) -> None:
        node.last = len(self.nodes) - 1
        node.end_string = len(self.strings)
        self._open_tags[node.tag] -= 1
        if node.tag in BLOCK_TAGS:
            self._blocks.pop()
            self._new_run = True
        elif self._links and self._links[-1] is node:
            self._links.pop()
        if node.parent >= 0 and (node.tag in BLOCK_TAGS or not node.leaf):
            self.nodes[node.parent].leaf = False
        if node.tag in SILENT_TAGS:
            self._silent -= 1
            if node.tag == "script" and self._script is not None:
                self.scripts.append((node.attrs, "".join(self._script)))
                self._script = None

    def finish(self) -> None:
        while self.open:
            self._shut(self.open.pop())


def _is_region(node: _Node) -> bool:
    marks = " ".join((node.attrs.get("class", ""), node.attrs.get("id", ""), node.attrs.get("aria-label", ""))).lower()
    return any(word in marks for word in REGION_WORDS)


def _written(value: object, script: int, out: list[dict]) -> str:
    """The JSON text of a value; appends every object in document order with its range in that text.

    ``top`` marks roots and graph members. One text for all objects and a stack of its own, so neither nesting nor
    the number of objects costs more than their length.
    """
    parts: list[str] = []
    size = 0
    todo: list[tuple[str, object, bool]] = [("value", value, True)]
    while todo:
        what, item, top = todo.pop()
        if what == "end":
            item["chars"] = size + 1 - item["first"]
            text = "}"
        elif what == "text":
            text = item
        elif isinstance(item, dict):
            kind = item.get("@type")
            kinds = [kind] if isinstance(kind, str) else [str(k) for k in kind] if isinstance(kind, list) else []
            row = {"script": script, "top": top, "kinds": kinds, "first": size, "chars": 0}
            out.append(row)
            todo.append(("end", row, False))
            for n, (key, inner) in enumerate(reversed(item.items())):
                todo.append(("value", inner, top and key == "@graph"))
                comma = ", " if n < len(item) - 1 else ""
                todo.append(("text", f"{comma}{json.dumps(key, ensure_ascii=False)}: ", False))
            text = "{"
        elif isinstance(item, list):
            todo.append(("text", "]", False))
            for n, inner in enumerate(reversed(item)):
                todo.append(("value", inner, top))
                if n < len(item) - 1:
                    todo.append(("text", ", ", False))
            text = "["
        else:
            text = json.dumps(item, ensure_ascii=False)
        parts.append(text)
        size += len(text)
    return "".join(parts)


def _candidates(value: object, origin: str, script: int, out: list[dict]) -> None:
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, _Found):
            out.append({"origin": origin, "script": script, "value": item.value})
        elif isinstance(item, dict):
            inner: list[object] = []
            for key, one in item.items():
                if not isinstance(one, str):
                    inner.append(one)
                elif any(word in str(key).lower() for word in URL_KEY_WORDS):
                    inner.append(_Found(one))
            todo.extend(reversed(inner))
        elif isinstance(item, list):
            todo.extend(reversed(item))


class _Found:
    __slots__ = ("value",)

    def __init__(self, value: str) -> None:
        self.value = value


def _text_runs(outline: _Outline, lengths: list[int], places: dict[int, int]) -> list[dict]:
    nearest: dict[str, list[int]] = {kind: [] for kind in BOXES}
    for node in outline.nodes:
        for kind, tags in BOXES.items():
            nearest[kind].append(node.pos if node.tag in tags else nearest[kind][node.parent] if node.parent >= 0 else -1)

    def size(first: int, end: int) -> int:
        return max(lengths[end] - lengths[first] - 1, 0)

    def box(kind: str, owner: int) -> int | None:
        at = nearest[kind][owner]
        if at < 0:
            return None
        node = outline.nodes[at]
        return 0 if node.leaf else size(node.first_string, node.end_string)

    return [
        {
            "owner": places.get(owner), "pos": owner, "first_piece": first, "pieces": end - first, "chars": size(first, end),
            "link": places.get(link), **{kind: box(kind, owner) for kind in BOXES},
        }
        for owner, first, end, link in outline.runs
    ]


def parse_page(html: str | None) -> dict[str, object]:
    """Elements, text pieces, JSON-LD and address candidates of a page; what could not be read is in ``parse_error``."""
    outline = _Outline()
    error = None
    outline.read(html or "")
    outline.finish()
    lengths = [0, *accumulate(len(s) + 1 for s in outline.strings)]
    read = [n for n in outline.nodes if n.tag in READ_TAGS or _is_region(n)]
    targets = [(n.pos, i) for i, n in enumerate(read) if n.tag == "a" and "href" in n.attrs]
    boxes: dict[int, int] = {}  # parents of anchors, each once however many anchors it has
    elements = []
    for node in read:
        around = boxes.setdefault(node.parent, len(boxes)) if node.tag == "a" and node.parent >= 0 else None
        at = bisect_right(targets, (node.pos, len(read)))
        link = targets[at][1] if at < len(targets) and targets[at][0] <= node.last else None
        elements.append(
            {
                "pos": node.pos,
                "last": node.last,
                "tag": node.tag,
                "attrs": list(node.attrs.items()),
                "first_piece": node.first_string,
                "pieces": node.end_string - node.first_string,
                "chars": max(lengths[node.end_string] - lengths[node.first_string] - 1, 0),
                "leaf": node.leaf,
                "link": link,
                "around": around,
            }
        )
    parents = [outline.nodes[p] for p in boxes]
    objects: list[dict] = []
    texts: list[str] = []
    scripts: list[str] = []
    candidates: list[dict] = []
    for number, (attrs, body) in enumerate(outline.scripts):
        is_ld = attrs.get("type") == "application/ld+json"
        if not is_ld and attrs.get("id") != "__NEXT_DATA__":
            continue
        if is_ld:
            scripts.append(body)
        try:
            value = json.loads(body)
        except (ValueError, RecursionError) as exc:
            if isinstance(exc, RecursionError):
                error = error or "JSON nested too deep"
            continue
        if is_ld:
            texts.append(_written(value, len(texts), objects))
        _candidates(value, "json_ld" if is_ld else "next_data", number, candidates)
    return {
        "elements": elements,
        "page_pieces": outline.strings,
        "text_runs": _text_runs(outline, lengths, {n.pos: i for i, n in enumerate(read)}),
        "link_boxes": [{"first_piece": p.first_string, "pieces": p.end_string - p.first_string} for p in parents],
        "json_ld": objects,
        "json_ld_texts": texts,
        "json_ld_scripts": scripts,
        "url_candidates": candidates,
        "parse_error": error,
    }


def _chunks(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` pages and about ``size`` bytes of html (at least one page each)."""
    lengths = [len(h) for h in batch.column("html").cast(pa.large_binary()).fill_null(b"").to_pylist()] if batch.num_rows else []
    start = held = 0
    for n, length in enumerate(lengths):
        if n > start and (n - start >= rows or held + length > size):
            yield batch.slice(start, n - start)
            start, held = n, 0
        held += length
    if lengths:
        yield batch.slice(start)


def parse_batches(batches: Iterator[pa.RecordBatch], rows: int = 64, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Replace the ``html`` column by the parsed columns, a bounded number of bytes and pages at a time."""
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "html"]
        for piece in _chunks(batch, rows, size):
            parsed = [parse_page(h.as_py()) for h in piece.column("html")]
            arrays = [piece.column(n) for n in kept]
            names = list(kept)
            for name, kind in PARSED_COLUMNS:
                arrays.append(pa.array([r[name] for r in parsed], type=kind))
                names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)


class PageElements:
    """Table function: the elements of one page, a row each; a page that could not be read whole says so in every row
    (in a row of its own if it has no element)."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        if html.isTable or not isinstance(html.dataType, (StringType, NullType)):
            raise ValueError("page_elements takes one string, the html of a page")
        text, number = StringType(), IntegerType()
        kinds = (("pos", number), ("last", number), ("tag", text), ("attrs", MapType(text, text)), ("text", text), ("link", text), ("parse_error", text))
        return AnalyzeResult(schema=StructType([StructField(name, kind) for name, kind in kinds]))

    def eval(self, html: str | None) -> Iterator[tuple]:
        page = parse_page(html)
        error, pieces, elements = page["parse_error"], page["page_pieces"], page["elements"]
        for e in elements:
            text = " ".join(pieces[e["first_piece"] : e["first_piece"] + e["pieces"]])
            link = None if e["link"] is None else dict(elements[e["link"]]["attrs"]).get("href")
            yield e["pos"], e["last"], e["tag"], dict(e["attrs"]), text, link, error
        if error and not elements:
            yield None, None, None, None, None, None, error

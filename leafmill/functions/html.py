"""One pass over a page: visible text, applied rules, noise classes and, if asked for, links."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import name2codepoint

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import functions as F

from leafmill import fixed_values as fv

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_ENTITY = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9A-Fa-f]+);?|([A-Za-z][A-Za-z0-9]*);)")
_NAMED = {**name2codepoint, "apos": 39}

# Facts of the HTML language and of common parsers, not of any one program.
_VOID = set(
    "area base basefont br col embed frame hr img input isindex link meta param "
    "source track wbr".split()
)
_RAW = {"script", "style"}
_NOT_PAGE_TEXT = {"template", "rt", "rp"}
_BLOCKS = set(
    "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li "
    "menu ol p pre table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY = {
    "p": _BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
    "head": {"body"},
}
# An end tag does not reach through an open element of higher rank.
_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}


def decode_entities(text: str) -> str:
    if "&" not in text:
        return text

    def char(m: re.Match) -> str:
        dec, hexa, name = m.groups()
        code = int(dec) if dec else int(hexa, 16) if hexa else _NAMED.get(name)
        valid = code and code < 0x110000 and not 0xD800 <= code < 0xE000
        return chr(code) if valid else m.group()

    return _ENTITY.sub(char, text)


class PageTree:
    """Elements and text pieces of a page in document order.

    An element covers the index ranges of the elements and pieces inside it, so
    removing it clears two ranges.
    """

    def __init__(self, html: str):
        self.names: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.spans: list[list[int]] = []  # [pieces from, pieces to, elements to]
        self.pieces: list[str] = []
        self._read(html)
        self.live = bytearray(b"\x01" * len(self.names))
        self.shown = bytearray(b"\x01" * len(self.pieces))

    def _read(self, html: str) -> None:
        stack: list[int] = []
        buffer: list[str] = []
        hidden_depth = 0
        pos, end = 0, len(html)

        def flush() -> None:
            if buffer:
                if not hidden_depth:
                    piece = decode_entities("".join(buffer)).strip()
                    if piece:
                        self.pieces.append(piece)
                buffer.clear()

        def close() -> None:
            nonlocal hidden_depth
            i = stack.pop()
            self.spans[i][1:] = len(self.pieces), len(self.names)
            hidden_depth -= self.names[i] in _NOT_PAGE_TEXT

        while pos < end:
            m = _TOKEN.search(html, pos)
            if m is None:
                buffer.append(html[pos:])
                break
            if m.start() > pos:
                buffer.append(html[pos : m.start()])
            pos = m.end()
            name = (m["name"] or "").lower()
            if not name:  # comment or declaration: splits the text around it
                flush()
                continue
            if m["end"]:
                at = len(stack) - 1
                rank = _RANK.get(name, 100)
                while at >= 0 and self.names[stack[at]] != name:
                    if _RANK.get(self.names[stack[at]], 100) > rank:
                        at = -1
                        break
                    at -= 1
                if at >= 0:
                    flush()
                    while len(stack) > at:
                        close()
                elif name == "p":
                    flush()
                continue
            flush()
            while stack and name in _CLOSED_BY.get(self.names[stack[-1]], ()):
                close()
            text = m["attrs"]
            found: dict[str, str] = {}
            if "=" in text:
                for key, double, single, bare in _ATTR.findall(text):
                    key = key.lower()
                    wanted = key in ("class", "id", "style") or key == "href" and name == "a"
                    if wanted and key not in found:
                        found[key] = decode_entities(double or single or bare)
            self.names.append(name)
            self.attrs.append(found)
            self.spans.append([len(self.pieces)] * 2 + [len(self.names)])
            if name in _RAW:
                close_at = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, pos)
                pos = close_at.end() if close_at else end
            elif name not in _VOID and not text.rstrip().endswith("/"):
                stack.append(len(self.names) - 1)
                hidden_depth += name in _NOT_PAGE_TEXT
        flush()
        while stack:
            close()

    def remove(self, i: int) -> None:
        start, to, last = self.spans[i]
        self.live[i:last] = bytes(last - i)
        self.shown[start:to] = bytes(to - start)

    def text_of(self, i: int) -> str:
        """All text inside an element, removed or not, on one line."""
        start, to, _ = self.spans[i]
        return " ".join(" ".join(self.pieces[start:to]).split())

    def text(self) -> str:
        kept = "\n".join(p for p, show in zip(self.pieces, self.shown) if show)
        return re.sub(r"\n{3,}", "\n\n", kept).strip()


_NOISE = re.compile(fv.NOISE_CLASS, re.I)
_CLASS_SPLIT = re.compile(r"\s+")


def _noise(tree: PageTree) -> list[dict]:
    counts: Counter[str] = Counter()
    for attrs in tree.attrs:
        for token in _CLASS_SPLIT.split(attrs.get("class", "").strip()):
            if _NOISE.search(token):
                counts[token] += 1
    return [
        {"class_name": name, "n": n, "pos": pos} for pos, (name, n) in enumerate(counts.items())
    ]


def _links(tree: PageTree) -> list[dict]:
    """Anchors with a target in page order; ``shown`` tells whether cleaning kept them."""
    return [
        {"text": tree.text_of(i), "url": attrs["href"].strip(), "shown": bool(tree.live[i])}
        for i, attrs in enumerate(tree.attrs)
        if "href" in attrs
    ]


#: What a rule can name: (tag | id | class, its value), with the ids of the rules that name it.
RuleIndex = dict[tuple[str, str], set[int]]


def rule_index(rules: list[dict]) -> RuleIndex:
    """Rules of one domain by what they name; repeated rows of a rule are one, and a rule without
    a selector names nothing."""
    index: RuleIndex = {}
    for rule in rules:
        if rule["selector"]:
            index.setdefault((rule["rule_type"], rule["selector"]), set()).add(rule["id"])
    return index


def _places(tree: PageTree) -> dict[tuple[str, str], list[int]]:
    """Elements by what rules can name, in page order."""
    places: dict[tuple[str, str], list[int]] = {}
    for i, (name, attrs) in enumerate(zip(tree.names, tree.attrs)):
        marks = {("tag", name), ("id", attrs.get("id", ""))}
        marks.update(("class", c) for c in _CLASS_SPLIT.split(attrs.get("class", "").strip()))
        for mark in marks:
            places.setdefault(mark, []).append(i)
    return places


def _apply_rules(tree: PageTree, index: RuleIndex) -> list[int]:
    """Apply rules in id order; a rule counts when it still finds something.

    One look at every element, then one look-up per distinct mark of the page: how many
    rules the domain has does not matter.
    """
    places = _places(tree)
    named = sorted((rule, mark) for mark in places for rule in index.get(mark, ()))
    applied = []
    for rule, mark in named:
        hits = [i for i in places[mark] if tree.live[i]]
        for i in hits[:1] if mark[0] == "id" else hits:
            tree.remove(i)
        if hits:
            applied.append(rule)
    return applied


def page_marks(html: str) -> list[tuple[str, str]]:
    """The distinct marks of a page that rules can name."""
    return sorted(mark for mark in _places(PageTree(html)) if mark[1])


_CLEAN_TYPE = pa.struct(
    [
        ("text", pa.string()),
        ("applied_rule_ids", pa.list_(pa.int64())),
        (
            "noise",
            pa.list_(
                pa.struct([("class_name", pa.string()), ("n", pa.int32()), ("pos", pa.int32())])
            ),
        ),
    ]
)
CLEAN_SCHEMA = (
    "struct<text:string,applied_rule_ids:array<bigint>,"
    "noise:array<struct<class_name:string,n:int,pos:int>>>"
)
_LINKS_TYPE = pa.struct(
    [
        *_CLEAN_TYPE,
        ("title", pa.string()),
        (
            "links",
            pa.list_(
                pa.struct([("text", pa.string()), ("url", pa.string()), ("shown", pa.bool_())])
            ),
        ),
    ]
)
LINKS_SCHEMA = (
    CLEAN_SCHEMA[:-1] + ",title:string,links:array<struct<text:string,url:string,shown:boolean>>>"
)


#: Bytes of html whose parsed pages a worker holds as Python objects at once.
_SLICE_BYTES = 1 << 20


def _slices(html: pa.Array) -> Iterator[slice]:
    """Ranges of rows with about ``_SLICE_BYTES`` of html each; a longer page is one for itself."""
    sizes = pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // _SLICE_BYTES
    low = 0
    for high in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(html)]:
        if high > low:
            yield slice(low, high)
        low = high


_DROPPED = set(fv.DROPPED_TAGS)
_PROFILES = {
    "standard": (
        re.compile("|".join(fv.OVERLAY_CLASSES), re.I),
        re.compile(fv.HIDDEN_STYLE, re.I),
    ),
    "compat": (
        re.compile("|".join(fv.OVERLAY_CLASSES_COMPAT), re.I),
        re.compile(fv.HIDDEN_STYLE),
    ),
}


def clean_page(
    html: str, rules: RuleIndex | None = None, profile: str = "standard", links: bool = False
) -> dict:
    """Visible text, applied rule ids and noise classes of one page; title and links too."""
    overlay, hidden = _PROFILES[profile]
    tree = PageTree(html)
    noise = _noise(tree)
    for i, name in enumerate(tree.names):
        attrs = tree.attrs[i]
        if (
            name in _DROPPED
            or (attrs.get("style") and hidden.search(attrs["style"]))
            or (attrs.get("class") and overlay.search(attrs["class"]))
        ):
            tree.remove(i)
    applied = _apply_rules(tree, rules) if rules else []
    out = {"text": tree.text(), "applied_rule_ids": applied, "noise": noise}
    if links:
        title = next((i for i, name in enumerate(tree.names) if name == "title"), None)
        out |= {"title": "" if title is None else tree.text_of(title), "links": _links(tree)}
    return out


def clean_html_udf(
    profile: str = "standard", links: bool = False, shared: Broadcast[dict[str, RuleIndex]] | None = None
):
    """Arrow UDF ``(html, rules) -> struct``; ``profile='compat'`` is the older variant.

    With ``shared``, an index of rules by domain that a worker loads once, the second
    argument is the page's domain instead: pages carry no rules. A batch is worked off in
    slices, so that a worker holds the parsed pages of one slice, however large the batch.
    """
    kind, schema = (_LINKS_TYPE, LINKS_SCHEMA) if links else (_CLEAN_TYPE, CLEAN_SCHEMA)

    def clean_html(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rules_of = shared.value.get if shared else lambda rules: rules and rule_index(rules)
        for html, by in batches:
            for s in _slices(html):
                yield pa.array(
                    [
                        clean_page(h or "", rules_of(b), profile, links)
                        for h, b in zip(html[s].to_pylist(), by[s].to_pylist())
                    ],
                    kind,
                )

    # Called non-deterministic so that a later filter on the text is not pushed below
    # this step as a second copy of it: every page is parsed once.
    return F.arrow_udf(clean_html, schema).asNondeterministic()


def page_marks_udf():
    """Arrow UDF ``html -> array<struct<rule_type, selector>>``: ``page_marks`` of every page."""
    kind = pa.list_(pa.struct([("rule_type", pa.string()), ("selector", pa.string())]))

    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            for s in _slices(html):
                yield pa.array(
                    [
                        [{"rule_type": t, "selector": v} for t, v in page_marks(h or "")]
                        for h in html[s].to_pylist()
                    ],
                    kind,
                )

    return F.arrow_udf(marks, "array<struct<rule_type:string,selector:string>>")

"""Structured extraction from HTML by CSS selectors.

Selectors: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=value]``, descendant and child (``>``) combinators, and
lists with commas. HTML is parsed by the standard library in Arrow batches; each page once for all fields.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose content is not text of the page.
HIDDEN = frozenset("script style template noscript".split())


@dataclass(frozen=True)
class Field:
    """One field: where to look, which attribute to take (the text if none), its type, and whether a row needs it."""

    css: str
    attr: str | None = None
    kind: str = "string"
    required: bool = True


def required_attributes(fields: dict[str, Field]) -> list[str]:
    return [k for k, f in fields.items() if f.required]


def optional_attributes(fields: dict[str, Field]) -> list[str]:
    return [k for k, f in fields.items() if not f.required]


def from_attributes(values: Column, fields: dict[str, Field]) -> Column:
    """A row made from a map of texts: each field in its type; null where a required one is absent or not of its type."""
    typed = {k: F.try_element_at(values, F.lit(k)).try_cast(f.kind) for k, f in fields.items()}
    whole = F.lit(True)
    for k in required_attributes(fields):
        whole = whole & typed[k].isNotNull()
    return F.when(whole, F.struct(*[c.alias(k) for k, c in typed.items()]))


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node | str] = []

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in HIDDEN or n is self:
                stack.extend(reversed(n.children))
        return re.sub(r"\s+", " ", "".join(parts)).strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.nodes: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and self.at.tag == tag:
            self.at = self.at.parent or self.root
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at, len(self.nodes))
        self.at.children.append(n)
        self.nodes.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> list[Node]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.nodes


_STEP = re.compile(r"\s*(>?)\s*((?:[\w*-]+|\.[\w-]+|#[\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])+)")
_PART = re.compile(r"([.#]?)([\w*-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]")


def compile_css(css: str) -> list[list[tuple[bool, list]]]:
    """Alternatives of steps (is a child step, tests); raises ``ValueError`` for what is not supported."""
    out = []
    for one in css.split(","):
        steps, at = [], 0
        one = one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if not m:
                raise ValueError(f"unsupported selector: {css!r}")
            tests = [(p[0] or ("=" if p[2] else "t"), p[1] or p[2], next((x for x in p[3:] if x), None) if p[2] else None) for p in _PART.findall(m.group(2))]
            steps.append((m.group(1) == ">", tests))
            at = m.end()
        if not steps:
            raise ValueError("empty selector")
        out.append(steps)
    return out


def _passes(n: Node, tests: list) -> bool:
    for kind, name, value in tests:
        if kind == "t" and name != "*" and n.tag != name.lower():
            return False
        if kind == "." and name not in n.attrs.get("class", "").split():
            return False
        if kind == "#" and n.attrs.get("id") != name:
            return False
        if kind == "=" and (name not in n.attrs or (value is not None and n.attrs[name] != value)):
            return False
    return True


def _matches(n: Node, steps: list, last: int) -> bool:
    if not _passes(n, steps[last][1]):
        return False
    if last == 0:
        return True
    above = n.parent
    if steps[last][0]:
        return above is not None and _matches(above, steps, last - 1)
    while above is not None:
        if _matches(above, steps, last - 1):
            return True
        above = above.parent
    return False


def find(nodes: list[Node], compiled: list) -> list[Node]:
    return [n for n in nodes if any(_matches(n, steps, len(steps) - 1) for steps in compiled)]


def _value(n: Node, attr: str | None, kind: str):
    raw = n.attrs.get(attr) if attr else n.text()
    if raw is None or kind == "string":
        return raw
    try:
        if kind in ("double", "float"):
            return float(raw.strip())
        if kind in ("int", "bigint"):
            return int(raw.strip())
        if kind == "boolean":
            return {"true": True, "false": False}[raw.strip().lower()]
    except (ValueError, KeyError):
        return None
    raise ValueError(f"unsupported type: {kind}")


def elements(html: Column, fields: dict[str, Field], many: bool = True) -> Column:
    """``many``: an array of rows, the n-th of each field's matches together; else one row of the first matches.

    A row without a required field is left out (``many``) or null. A null page gives null.
    """
    compiled = {k: compile_css(f.css) for k, f in fields.items()}
    row_type = f"struct<{', '.join(f'{k}:{f.kind}' for k, f in fields.items())}>"

    def rows_of(page):
        nodes = parse(page)
        columns = {k: [_value(n, f.attr, f.kind) for n in find(nodes, compiled[k])] for k, f in fields.items()}
        size = max((len(c) for c in columns.values()), default=0)
        rows = [{k: c[i] if i < len(c) else None for k, c in columns.items()} for i in range(size)]
        return [r for r in rows if all(r[k] is not None for k, f in fields.items() if f.required)]

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else rows_of(p))

    out = F.pandas_udf(run, f"array<{row_type}>")(html)
    return out if many else F.get(out, F.lit(0))


def _views(pages: pd.Series) -> pd.DataFrame:
    out = []
    for p in pages:
        if p is None:
            out.append((None, None))
            continue
        nodes = parse(p)
        title = next((n.text() for n in nodes if n.tag == "title"), "")
        body = next((n for n in nodes if n.tag == "body"), None)
        out.append((title, body.text() if body else " ".join(n.text() for n in nodes if n.parent is not None and not n.parent.tag and n.tag not in ("title", "head"))))
    return pd.DataFrame(out, columns=["title", "text"])


def view(html: Column, url: Column) -> Column:
    """struct(title, source, current_url, text) of a stored page."""
    v = F.pandas_udf(_views, "struct<title:string,text:string>")(html)
    return F.struct(v["title"].alias("title"), html.alias("source"), url.alias("current_url"), v["text"].alias("text"))

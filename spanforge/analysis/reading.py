"""Reading: maps of texts, picking of parts, and marking of hits.  These serve one document at a time, on the driver or in a UDF."""

from __future__ import annotations

import html
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from spanforge.analysis.markup import StructureDefinition, elements, fill_template, matches


@dataclass
class MapNode:
    """A part of a text: label, place in the tree, and the characters [start, end)."""

    label: str
    path: str
    start: int
    end: int
    selected: bool = False
    parent: MapNode | None = field(default=None, repr=False, compare=False)
    children: list[MapNode] = field(default_factory=list)

    def add(self, child: MapNode) -> MapNode:
        child.parent = self
        self.children.append(child)
        return child

    def place(self) -> str:
        """Numbers of the children from the root, such as 0.2.1."""
        if self.parent is None:
            return "0"
        return f"{self.parent.place()}.{next(k for k, c in enumerate(self.parent.children) if c is self)}"

    def descendant(self, place: str) -> MapNode | None:
        node = self
        for k in place.split(".")[1:]:
            if int(k) >= len(node.children):
                return None
            node = node.children[int(k)]
        return node

    def visit(self) -> Iterator[MapNode]:
        yield self
        for c in self.children:
            yield from c.visit()

    def ancestors(self) -> list[MapNode]:
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.parent
        return out

    def dump(self, depth: int = 0) -> str:
        line = f"{'.' * depth}{self.label}\t{self.path}\t{self.start}\t{self.end}\n"
        return line + "".join(c.dump(depth + 1) for c in self.children)


def common_ancestor(a: MapNode, b: MapNode) -> MapNode | None:
    of_a = {id(x) for x in a.ancestors()}
    return next((x for x in b.ancestors() if id(x) in of_a), None)


def parse_map(text: str) -> MapNode | None:
    """What dump wrote."""
    stack: list[MapNode] = []
    for line in text.splitlines():
        head, path, start, end = line.split("\t")
        label = head.lstrip(".")
        depth = len(head) - len(label)
        node = MapNode(label, path, int(start), int(end))
        del stack[depth:]
        if stack:
            stack[-1].add(node)
        stack.append(node)
    return stack[0] if stack else None


def map_text(text: str, definitions: Sequence[StructureDefinition]) -> MapNode:
    """A tree of the elements that the definitions name; elements between them are passed over."""
    every = elements(text)
    root = MapNode("document", "/", 0, len(text))
    nodes: dict[int, MapNode] = {}
    for k, e in enumerate(every):
        d = next((d for d in definitions if matches(d.path, e, every)), None)
        if d is None:
            continue
        p = e.parent
        while p >= 0 and p not in nodes:
            p = every[p].parent
        label = fill_template(d.value, text, e) or d.type
        nodes[k] = (nodes[p] if p >= 0 else root).add(MapNode(label[:80], e.path, e.start, e.end))
    return root


def pick_node(text: str, node: MapNode) -> str:
    return text[node.start : node.end]


def pick_range(text: str, root: MapNode, start: int, end: int, before: str = "{{", after: str = "}}") -> tuple[str, MapNode]:
    """The least part of the map that holds the characters [start, end), with the hit marked, and its node."""
    node = root
    while inner := next((c for c in node.children if c.start <= start and end <= c.end), None):
        node = inner
    node.selected = True
    return highlight(text[node.start : node.end], [(start - node.start, end - node.start)], before, after), node


def highlight(text: str, ranges: Sequence[tuple[int, int]], before: str = "<hi>", after: str = "</hi>") -> str:
    """Marks ranges of characters; tags inside a range stay outside of the marks, so the markup stays well-formed."""
    import re

    out, at = [], 0
    for a, b in sorted(ranges):
        a = max(a, at)
        if a >= b:
            continue
        out.append(text[at:a])
        for piece in re.split(r"(<[^>]*>)", text[a:b]):
            out.append(piece if not piece or piece.startswith("<") else before + piece + after)
        at = b
    return "".join(out) + text[at:]


def to_html(text: str) -> str:
    """A plain rendering: paragraphs of the text without markup."""
    import re

    plain = re.sub(r"<[^>]*>", "", text)
    return "".join(f"<p>{html.escape(p.strip())}</p>" for p in plain.split("\n") if p.strip())


class DocumentReader:
    """Texts with their maps, of which the last few stay in memory."""

    def __init__(self, load, definitions: Sequence[StructureDefinition], most: int = 16):
        self.load, self.definitions, self.most = load, definitions, most
        self.cache: dict[int, tuple[str, MapNode]] = {}

    def get(self, document_id: int) -> tuple[str, MapNode] | None:
        if document_id not in self.cache:
            text = self.load(document_id)
            if text is None:
                return None
            while len(self.cache) >= self.most:
                self.cache.pop(next(iter(self.cache)))
            self.cache[document_id] = text, map_text(text, self.definitions)
        return self.cache[document_id]

    def read(self, document_id: int, place: str) -> str | None:
        found = self.get(document_id)
        node = found and found[1].descendant(place)
        return pick_node(found[0], node) if node else None

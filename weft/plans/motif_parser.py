"""The motif language: text to a list of terms.

    motif  := term (";" term)*
    term   := vertex | ["!"] edge
    vertex := "(" [name] ")"
    edge   := vertex "-[" [name] [hops] "]->" vertex, also with "<-[ ]-", "<-[ ]->" and "-[ ]-"
    hops   := "*" k | "*" m ".." n
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from weft.errors import PatternError

VERTEX = re.compile(r"\((\w*)\)", re.A)
EDGE = re.compile(r"(!?)\((\w*)\)(<?)-\[(\w*)(\*[\d.]*)?\]-(>?)\((\w*)\)", re.A)


@dataclass(frozen=True)
class Vertex:
    name: str


@dataclass(frozen=True)
class Edge:
    name: str
    src: str
    dst: str
    directed: bool = True
    negated: bool = False


@dataclass(frozen=True)
class VarLength:
    """A whole motif of one edge with a range of hops, or of one undirected edge with hops."""

    name: str
    src: str
    dst: str
    least: int
    most: int
    directed: bool


def hops(spec: str, pattern: str) -> tuple[int, int]:
    m = re.fullmatch(r"\*(\d+)(?:\.\.(\d+))?", spec)
    if not m:
        raise PatternError("Hops need a number or a bounded range", pattern)
    least = int(m[1])
    most = least if m[2] is None else int(m[2])
    if least < 1 or most < least:
        raise PatternError("Hops must be at least 1, and a range ascending", pattern)
    return least, most


def chain(name: str, src: str, dst: str, k: int) -> list[Edge]:
    """k edges in a row; middle vertices are named after the ends."""
    middle = [f"__tmpv{i}" if not src and not dst else f"_{src}{dst}{i}" for i in range(1, k)]
    stops = [src, *middle, dst]
    return [Edge(f"_{name}{i + 1}" if name else "", stops[i], stops[i + 1]) for i in range(k)]


def parse(pattern: str) -> list[Vertex | Edge] | VarLength:
    pieces = [p.strip() for p in pattern.split(";")]
    if pieces[-1] == "":
        pieces.pop()  # a trailing semicolon, or nothing at all
    terms: list[Vertex | Edge] = []
    for piece in pieces:
        text = re.sub(r"\s+", "", piece)
        if v := VERTEX.fullmatch(text):
            terms.append(Vertex(v[1]))
            continue
        m = EDGE.fullmatch(text)
        if not m:
            raise PatternError(f"Can't parse term {piece!r}", pattern)
        negated, a, back, name, spec, forth, b = m.groups()
        negated = bool(negated)
        if negated and name:
            raise PatternError("Motif finding does not support negated named edges", pattern)
        if negated and back and forth:
            raise PatternError("Motif finding does not support negated bidirectional edges", pattern)
        least = most = None
        if spec:
            least, most = hops(spec, pattern)
            if negated:
                raise PatternError("Motif finding does not support negated edges of several hops", pattern)
        if spec and (least != most or not (back or forth)):
            if len(pieces) > 1:
                raise PatternError("An edge of variable or undirected length must be the whole motif", pattern)
            if back:
                raise PatternError("A range of hops must point forwards or be undirected", pattern)
            if not a and not b and not name:
                raise PatternError("Motif finding does not support completely anonymous edges", pattern)
            return VarLength(name, a, b, least, most, bool(forth))
        if back and forth:
            ways = [(f"{name}{i}" if name and not spec else name, *ends) for i, ends in ((1, (a, b)), (2, (b, a)))]
        else:
            ways = [(name, b, a) if back else (name, a, b)]
        for n, s, d in ways:
            terms += chain(n, s, d, least) if spec else [Edge(n, s, d, bool(back or forth), negated)]
    validate(terms, pattern)
    return terms


def validate(terms: list[Vertex | Edge], pattern: str) -> None:
    vertices: set[str] = set()
    edges: set[str] = set()
    for t in terms:
        if isinstance(t, Vertex):
            if not t.name:
                raise PatternError("Motif finding does not allow a lone anonymous vertex", pattern)
            vertices.add(t.name)
            continue
        if not (t.name or t.src or t.dst):
            raise PatternError("Motif finding does not support completely anonymous edges", pattern)
        if t.name in edges and t.name:
            raise PatternError(f"Name {t.name!r} is used for several edges", pattern)
        if t.name:
            edges.add(t.name)
        vertices |= {t.src, t.dst} - {""}
    if both := vertices & edges:
        raise PatternError(f"Name {min(both)!r} is used for both a vertex and an edge", pattern)


def only_negated(terms: list[Vertex | Edge]) -> list[str]:
    """Vertices that are named in negated terms only, sorted."""
    ends = lambda ts: {n for t in ts for n in ((t.name,) if isinstance(t, Vertex) else (t.src, t.dst)) if n}
    negated = [t for t in terms if isinstance(t, Edge) and t.negated]
    return sorted(ends(negated) - ends([t for t in terms if t not in negated]))


def names_in_order(terms: list[Vertex | Edge]) -> list[str]:
    """Named elements as they first appear; helper vertices are left out."""
    every = [n for t in terms for n in ((t.name,) if isinstance(t, Vertex) else (t.src, t.name, t.dst))]
    return [n for n in dict.fromkeys(every) if n and not n.startswith("__tmpv")]

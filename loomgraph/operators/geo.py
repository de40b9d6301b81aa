r"""Geometries: WKT and GeoJSON literals, relations, measures, constructions, joins.

A geometry is (points, lines, polygons).  Relations come from one matrix of
dimensions (interior, boundary, exterior of both): every piece of one geometry
is cut at the other's lines and its middle is located in the other.  Columns run
through Arrow batches.  Joins of two tables meet in grid cells by an equi-join
before the exact test, and a pair that meets in several cells is tested in one.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlay

EARTH = 6_371_008.8
EPS = 1e-9
Point = tuple[float, float]


@dataclass
class Geometry:
    points: list[Point] = field(default_factory=list)
    lines: list[list[Point]] = field(default_factory=list)
    polygons: list[list[list[Point]]] = field(default_factory=list)
    kind: str = "POINT"
    srid: str = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"

    def empty(self) -> bool:
        return not (self.points or self.lines or self.polygons)

    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0

    def coordinates(self) -> list[Point]:
        return [*self.points, *[p for line in self.lines for p in line], *[p for poly in self.polygons for ring in poly for p in ring]]


# ---------------------------------------------------------------- reading, writing

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _numbers(text: str) -> list[Point]:
    out = []
    for part in text.split(","):
        n = [float(x) for x in _NUMBER.findall(part)]
        if len(n) >= 2:
            out.append((n[0], n[1]))
    return out


def _groups(text: str) -> list[str]:
    """The bracketed parts of a list, without their brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "(":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif c == ")":
            depth -= 1
            if not depth:
                out.append(text[start:i])
    return out


@lru_cache(maxsize=4096)
def parse(text: str | None) -> Geometry | None:
    """A WKT or GeoJSON geometry; None if it is neither."""
    if text is None:
        return None
    text = text.strip()
    if text.startswith("{"):
        try:
            return _from_json(json.loads(text))
        except (ValueError, KeyError, TypeError):
            return None
    srid = Geometry().srid
    if m := re.match(r"<([^>]*)>\s*", text):
        srid, text = m[1], text[m.end() :]
    m = re.match(r"([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(EMPTY|\(.*\))\s*$", text, re.S | re.I)
    if not m:
        return None
    kind, body = m[1].upper(), m[2]
    g = Geometry(kind=kind, srid=srid)
    if body.upper() == "EMPTY":
        return g
    inner = body[1:-1]
    if kind == "POINT":
        g.points = _numbers(inner)
    elif kind == "MULTIPOINT":
        g.points = _numbers(inner.replace("(", "").replace(")", ""))
    elif kind == "LINESTRING":
        g.lines = [_numbers(inner)]
    elif kind == "MULTILINESTRING":
        g.lines = [_numbers(x) for x in _groups(inner)]
    elif kind == "POLYGON":
        g.polygons = [[_numbers(x) for x in _groups(inner)]]
    elif kind == "MULTIPOLYGON":
        g.polygons = [[_numbers(y) for y in _groups(x)] for x in _groups(inner)]
    elif kind == "GEOMETRYCOLLECTION":
        for part in re.findall(r"[A-Za-z]+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", inner):
            if (p := parse(part)) is not None:
                g.points += p.points
                g.lines += p.lines
                g.polygons += p.polygons
    else:
        return None
    return g


def _from_json(x: dict) -> Geometry:
    kind, c = x["type"], x.get("coordinates")
    point = lambda p: (float(p[0]), float(p[1]))
    g = Geometry(kind=kind.upper())
    if kind == "Point":
        g.points = [point(c)]
    elif kind == "MultiPoint":
        g.points = [point(p) for p in c]
    elif kind == "LineString":
        g.lines = [[point(p) for p in c]]
    elif kind == "MultiLineString":
        g.lines = [[point(p) for p in line] for line in c]
    elif kind == "Polygon":
        g.polygons = [[[point(p) for p in ring] for ring in c]]
    elif kind == "MultiPolygon":
        g.polygons = [[[point(p) for p in ring] for ring in poly] for poly in c]
    elif kind == "GeometryCollection":
        for part in x["geometries"]:
            p = _from_json(part)
            g.points += p.points
            g.lines += p.lines
            g.polygons += p.polygons
    return g


def _n(x: float) -> str:
    return repr(round(x, 9)).removesuffix(".0") if abs(x) < 1e15 else repr(x)


def _seq(ps: list[Point]) -> str:
    return "(" + ", ".join(f"{_n(x)} {_n(y)}" for x, y in ps) + ")"


def wkt(g: Geometry) -> str:
    if g.empty():
        return f"{g.kind} EMPTY"
    parts = [f"POINT{_seq([p])}" for p in g.points] + [f"LINESTRING{_seq(line)}" for line in g.lines] + [f"POLYGON({', '.join(_seq(r) for r in poly)})" for poly in g.polygons]
    if len(parts) == 1:
        return parts[0]
    if not g.lines and not g.polygons:
        return f"MULTIPOINT{_seq(g.points)}"
    if not g.points and not g.polygons:
        return f"MULTILINESTRING({', '.join(_seq(line) for line in g.lines)})"
    if not g.points and not g.lines:
        return f"MULTIPOLYGON({', '.join('(' + ', '.join(_seq(r) for r in poly) + ')' for poly in g.polygons)})"
    return f"GEOMETRYCOLLECTION({', '.join(parts)})"


def geojson(g: Geometry) -> str:
    ls = lambda ps: [list(p) for p in ps]
    parts = [{"type": "Point", "coordinates": list(p)} for p in g.points] + [{"type": "LineString", "coordinates": ls(line)} for line in g.lines] + [{"type": "Polygon", "coordinates": [ls(r) for r in poly]} for poly in g.polygons]
    return json.dumps(parts[0] if len(parts) == 1 else {"type": "GeometryCollection", "geometries": parts})


# ---------------------------------------------------------------- location, relation


def _segments(g: Geometry) -> list[tuple[Point, Point]]:
    return [(a, b) for line in g.lines for a, b in zip(line, line[1:]) if a != b]


def _rings(g: Geometry) -> list[tuple[Point, Point]]:
    return [(a, b) for poly in g.polygons for ring in poly for a, b in zip(ring, ring[1:]) if a != b]


def _on(p: Point, a: Point, b: Point) -> bool:
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = math.hypot(dx, dy)
    if abs((p[0] - a[0]) * dy - (p[1] - a[1]) * dx) > EPS * max(1.0, size):
        return False
    t = (p[0] - a[0]) * dx + (p[1] - a[1]) * dy
    return -EPS <= t <= size * size + EPS


def _in_ring(p: Point, ring: list[Point]) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def _ends(g: Geometry) -> set[Point]:
    """The boundary points of the lines: ends that an odd number of lines have."""
    count: dict[Point, int] = {}
    for line in g.lines:
        if line and line[0] != line[-1]:
            for p in (line[0], line[-1]):
                count[p] = count.get(p, 0) + 1
    return {p for p, n in count.items() if n % 2}


def locate(p: Point, g: Geometry) -> str:
    """I, B or E: where a point lies in a geometry."""
    edge = False
    for poly in g.polygons:
        if any(_on(p, a, b) for ring in poly for a, b in zip(ring, ring[1:])):
            edge = True
        elif poly and _in_ring(p, poly[0]) and not any(_in_ring(p, hole) for hole in poly[1:]):
            return "I"
    if edge:
        return "B"
    for line in g.lines:
        if any(_on(p, a, b) for a, b in zip(line, line[1:])):
            return "B" if any(math.hypot(p[0] - e[0], p[1] - e[1]) <= EPS for e in _ends(g)) else "I"
    return "I" if any(math.hypot(p[0] - q[0], p[1] - q[1]) <= EPS for q in g.points) else "E"


def _cuts(a: Point, b: Point, others: list[tuple[Point, Point]], points: list[Point]) -> list[float]:
    """Where a segment meets segments or points, as shares of its length."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    out = {0.0, 1.0}
    for c, d in others:
        ex, ey = d[0] - c[0], d[1] - c[1]
        cross = dx * ey - dy * ex
        if abs(cross) > 1e-15:
            t = ((c[0] - a[0]) * ey - (c[1] - a[1]) * ex) / cross
            u = ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / cross
            if -EPS <= u <= 1 + EPS and 0 < t < 1:
                out.add(t)
        else:
            for p in (c, d):
                if _on(p, a, b):
                    out.add(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))
    for p in points:
        if _on(p, a, b):
            out.add(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))
    return sorted(t for t in out if 0 <= t <= 1)


def _inside_point(poly: list[list[Point]]) -> Point | None:
    """A point inside a polygon: the middle of the widest stretch of a scan line."""
    ys = sorted({p[1] for ring in poly for p in ring})
    best = None
    for lo, hi in zip(ys, ys[1:]):
        y = (lo + hi) / 2
        xs = sorted((x2 - x1) * (y - y1) / (y2 - y1) + x1 for ring in poly for (x1, y1), (x2, y2) in zip(ring, ring[1:]) if (y1 > y) != (y2 > y))
        for l, r in zip(xs[::2], xs[1::2]):
            if best is None or r - l > best[0]:
                best = (r - l, ((l + r) / 2, y))
    return best[1] if best else None


def _pieces(g: Geometry, h: Geometry) -> list[tuple[str, int, Point]]:
    """(I or B, dimension, sample point) of g's parts, cut so that each lies in one part of h."""
    others, points = _segments(h) + _rings(h), h.points + list(_ends(h))
    out: list[tuple[str, int, Point]] = [("I", 0, p) for p in g.points]
    ends = _ends(g)
    for part, segments in (("I", _segments(g)), ("B", _rings(g))):
        for a, b in segments:
            ts = _cuts(a, b, others, points)
            at = lambda t, a=a, b=b: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            out += [(part, 1, at((s + t) / 2)) for s, t in zip(ts, ts[1:]) if t - s > EPS]
            out += [("B" if part == "B" or at(t) in ends else "I", 0, at(t)) for t in ts]
    out += [("B", 0, p) for p in ends]
    return out


def relate(a: Geometry, b: Geometry) -> str:
    """The nine dimensions (F, 0, 1, 2) of interior, boundary, exterior against the other's."""
    m = {x + y: -1 for x in "IBE" for y in "IBE"}
    m["EE"] = 2

    def put(x: str, y: str, d: int) -> None:
        m[x + y] = max(m[x + y], d)

    for g, h, turn in ((a, b, False), (b, a, True)):
        for part, d, p in _pieces(g, h):
            at = locate(p, h)
            mine = locate(p, g) if part == "B" and g.polygons else part
            put(*((at, mine) if turn else (mine, at)), d)
            if g.polygons and part == "B" and d == 1:
                # Beside a polygon's edge lies its inside, and beyond it its outside.
                if at == "I" and h.polygons:
                    put(*(("I", "I")), 2)
                    put(*(("I", "E") if turn else ("E", "I")), 2)
                elif at == "E":
                    put(*(("E", "I") if turn else ("I", "E")), 2)
        for poly in g.polygons:
            p = _inside_point(poly)
            if p is not None:
                at = locate(p, h)
                if at != "B":
                    put(*((at, "I") if turn else ("I", at)), 2 if at == "E" or h.polygons else h.dimension())
        if g.polygons and not h.polygons:
            put(*(("E", "I") if turn else ("I", "E")), 2)
    if a.polygons and b.polygons and m["II"] < 2 and m["BB"] == 1 and m["IE"] < 2 and m["EI"] < 2:
        m["II"] = 2
    if a.polygons and b.polygons and m["II"] == 2:
        # Boundaries that are not the same leave something of one outside the other.
        if m["BE"] >= 1:
            m["IE"] = 2
        if m["EB"] >= 1:
            m["EI"] = 2
    return "".join("F" if m[x + y] < 0 else str(m[x + y]) for x in "IBE" for y in "IBE")


def matches(matrix: str, pattern: str) -> bool:
    return all(p == "*" or p == "T" and c != "F" or p == c for c, p in zip(matrix, pattern))


# The patterns of the standard's relations.
_SF = {"sfEquals": ("TFFFTFFFT", "T*F**FFF*"), "sfDisjoint": ("FF*FF****",), "sfTouches": ("FT*******", "F**T*****", "F***T****"), "sfWithin": ("T*F**F***",), "sfContains": ("T*****FF*",)}
_EH = {"ehEquals": "TFFFTFFFT", "ehDisjoint": "FF*FF****", "ehMeet": "FT******* F**T***** F***T****", "ehOverlap": "T*T***T**", "ehCovers": "T*TFT*FF*", "ehCoveredBy": "TFF*TFT**", "ehInside": "TFF*FFT**", "ehContains": "T*TFF*FF*"}
_RCC = {"rcc8eq": "TFFFTFFFT", "rcc8dc": "FFTFFTTTT", "rcc8ec": "FFTFTTTTT", "rcc8po": "TTTTTTTTT", "rcc8tppi": "TTTFTTFFT", "rcc8tpp": "TFFTTFTTT", "rcc8ntpp": "TFFTFFTTT", "rcc8ntppi": "TTTFFTFFT"}


@lru_cache(maxsize=16384)
def _matrix(a: str, b: str) -> str:
    """The matrix of two literals, kept for the other relations of the same rows: a batch has ten thousand of them."""
    return relate(parse(a), parse(b))  # type: ignore[arg-type]


#: Longer literals are not kept.
KEPT = 1024


def _named(name: str, s: str | None, t: str | None) -> bool | None:
    """A named relation of two literals; what does not parse gives null."""
    a, b = parse(s), parse(t)
    return relation(name, a, b, _matrix(s, t) if a and b and not a.empty() and not b.empty() and len(s) + len(t) <= 2 * KEPT else None)  # type: ignore[arg-type]


def relation(name: str, a: Geometry | None, b: Geometry | None, matrix: str | None = None) -> bool | None:
    """One of the twenty-four named relations; ``matrix`` if it is known."""
    if a is None or b is None:
        return None
    if a.empty() or b.empty():
        return name in ("sfDisjoint", "ehDisjoint", "rcc8dc") or name in ("sfEquals", "ehEquals", "rcc8eq") and a.empty() and b.empty()
    m = matrix or relate(a, b)
    if name == "sfIntersects":
        return not matches(m, _SF["sfDisjoint"][0])
    if name == "sfCrosses":
        da, db = a.dimension(), b.dimension()
        return m[0] == "0" if da == db == 1 else matches(m, "T*T******") if da < db else da > db and matches(m, "T*****T**")
    if name == "sfOverlaps":
        da, db = a.dimension(), b.dimension()
        return da == db and matches(m, "1*T***T**" if da == 1 else "T*T***T**")
    if name in _SF:
        return any(matches(m, p) for p in _SF[name])
    found = _EH.get(name) or _RCC.get(name)
    if found is None:
        raise ValueError(f"no relation {name!r}")
    return any(matches(m, p) for p in found.split())


RELATIONS = [*_SF, "sfIntersects", "sfCrosses", "sfOverlaps", *_EH, *_RCC]

# ---------------------------------------------------------------- measures


def haversine(a: Point, b: Point) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def _planar(a: Point, b: Point) -> float:
    return math.hypot(a[0] - b[0], a[1] - b[1])


# Metres (or radians' share) of length units.
UNITS = {"metre": 1.0, "meter": 1.0, "kilometre": 1000.0, "kilometer": 1000.0, "mile": 1609.344, "foot": 0.3048, "yard": 0.9144, "nauticalMile": 1852.0, "degree": None, "radian": None}


def _ring_area(ring: list[Point], planar: bool) -> float:
    if planar:
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2
    total = sum(math.radians(b[0] - a[0]) * (2 + math.sin(math.radians(a[1])) + math.sin(math.radians(b[1]))) for a, b in zip(ring, ring[1:]))
    return abs(total) * EARTH * EARTH / 2


def area(g: Geometry, planar: bool = True) -> float:
    return sum(_ring_area(p[0], planar) - sum(_ring_area(h, planar) for h in p[1:]) for p in g.polygons if p)


def length(g: Geometry, planar: bool = True) -> float:
    f = _planar if planar else haversine
    return sum(f(a, b) for line in g.lines for a, b in zip(line, line[1:])) + sum(f(a, b) for a, b in _rings(g))


def _near(p: Point, a: Point, b: Point) -> Point:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0 if not n else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return (a[0] + t * dx, a[1] + t * dy)


def distance(a: Geometry, b: Geometry, planar: bool = True) -> float | None:
    if a.empty() or b.empty():
        return None
    if a.dimension() + b.dimension() and relation("sfIntersects", a, b):
        return 0.0
    f = _planar if planar else haversine
    best = math.inf
    for g, h in ((a, b), (b, a)):
        edges = _segments(h) + _rings(h)
        for p in g.coordinates():
            for s, t in edges:
                best = min(best, f(p, _near(p, s, t)))
            for q in h.points:
                best = min(best, f(p, q))
    return best


def centroid(g: Geometry) -> Geometry:
    if g.polygons:
        w = x = y = 0.0
        for poly in g.polygons:
            for k, ring in enumerate(poly):
                for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                    c = x1 * y2 - x2 * y1
                    sign = 1 if (sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) > 0) == (k == 0) else -1
                    w, x, y = w + sign * c / 2, x + sign * (x1 + x2) * c / 6, y + sign * (y1 + y2) * c / 6
        if w:
            return Geometry([(x / w, y / w)])
    if g.lines:
        parts = [(_planar(a, b), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in _segments(g)]
        w = sum(p[0] for p in parts)
        if w:
            return Geometry([(sum(p[0] * p[1] for p in parts) / w, sum(p[0] * p[2] for p in parts) / w)])
    ps = g.coordinates()
    return Geometry([(sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps))]) if ps else Geometry()


def envelope(g: Geometry) -> Geometry:
    ps = g.coordinates()
    if not ps:
        return Geometry(kind="POLYGON")
    x1, y1, x2, y2 = min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)
    return Geometry(polygons=[[[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]], kind="POLYGON")


def convex_hull(g: Geometry) -> Geometry:
    ps = sorted(set(g.coordinates()))
    if len(ps) < 3:
        return Geometry(points=ps[:1]) if len(ps) < 2 else Geometry(lines=[ps], kind="LINESTRING")

    def half(points: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = half(ps)[:-1] + half(ps[::-1])[:-1]
    if len(ring) < 3:
        return Geometry(lines=[[ps[0], ps[-1]]], kind="LINESTRING")
    return Geometry(polygons=[[[*ring, ring[0]]]], kind="POLYGON")


def buffer(g: Geometry, radius: float, steps: int = 32) -> Geometry:
    """The convex buffer: the hull of circles about the points (exact for convex geometries)."""
    ps = [(x + radius * math.cos(2 * math.pi * k / steps), y + radius * math.sin(2 * math.pi * k / steps)) for x, y in g.coordinates() for k in range(steps)]
    return convex_hull(Geometry(points=ps))


def boundary(g: Geometry) -> Geometry:
    if g.polygons:
        return Geometry(lines=[ring for poly in g.polygons for ring in poly], kind="MULTILINESTRING")
    return Geometry(points=sorted(_ends(g)), kind="MULTIPOINT")


def is_simple(g: Geometry) -> bool:
    """Whether no line meets itself but at its ends."""
    if len(set(g.points)) < len(g.points):
        return False
    for line in g.lines:
        segs = [(a, b) for a, b in zip(line, line[1:]) if a != b]
        for i, (a, b) in enumerate(segs):
            for j in range(i + 1, len(segs)):
                c, d = segs[j]
                ts = [t for t in _cuts(a, b, [(c, d)], []) if any(_on((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])), c, d) for _ in (0,))]
                touch = [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) for t in ts]
                fine = {b} if j == i + 1 else {a} if i == 0 and j == len(segs) - 1 and line[0] == line[-1] else set()
                if any(all(_planar(p, q) > EPS for q in fine) for p in touch):
                    return False
    return True


def _made(points: list[Point], lines: list[list[Point]], polygons: list) -> Geometry:
    """A geometry of the simplest kind that holds these parts."""
    kinds = [(points, "POINT"), (lines, "LINESTRING"), (polygons, "POLYGON")]
    full = [(x, k) for x, k in kinds if x]
    kind = "GEOMETRYCOLLECTION" if len(full) != 1 else full[0][1] if len(full[0][0]) == 1 else "MULTI" + full[0][1]
    return Geometry(list(points), list(lines), list(polygons), kind)


def intersection(a: Geometry, b: Geometry) -> Geometry:
    """What both have: areas, line parts and points that lie in no larger part."""
    polygons = overlay.areas(a.polygons, b.polygons, "intersection") if a.polygons and b.polygons else []
    lines, points = [], []
    for x, y in ((a, b), (b, a)):
        if x.lines and y.polygons:
            lines += overlay.lines_in_area(x.lines, y.polygons, True)
        points += [p for p in x.points if locate(p, y) != "E" and p not in points]
    if a.lines and b.lines:
        shared, crossed = overlay.lines_on_lines(a.lines, b.lines, True)
        lines += shared
        points += [p for p in crossed if p not in points]
    return _made(points, lines, polygons)


def difference(a: Geometry, b: Geometry) -> Geometry:
    """What the first has and the second has not."""
    polygons = overlay.areas(a.polygons, b.polygons, "difference") if a.polygons and b.polygons else a.polygons
    lines = overlay.lines_in_area(a.lines, b.polygons, False) if a.lines and b.polygons else a.lines
    if lines and b.lines:
        lines = overlay.lines_on_lines(lines, b.lines, False)[0]
    return _made([p for p in a.points if locate(p, b) == "E"], lines, polygons)


def union(a: Geometry, b: Geometry) -> Geometry:
    """What either has; parts that lie in a larger one are left out."""
    polygons = overlay.areas(a.polygons, b.polygons, "union") if a.polygons and b.polygons else a.polygons or b.polygons
    area = Geometry(polygons=polygons)
    extra = overlay.lines_on_lines(b.lines, a.lines, False)[0] if a.lines and b.lines else b.lines
    lines = [*a.lines, *extra]
    lines = overlay.lines_in_area(lines, polygons, False) if lines and polygons else lines
    rest = Geometry(lines=lines, polygons=polygons)
    return _made([p for p in dict.fromkeys(a.points + b.points) if locate(p, rest if not area.empty() or lines else area) == "E"], lines, polygons)


def sym_difference(a: Geometry, b: Geometry) -> Geometry:
    """What exactly one of them has."""
    x, y = difference(a, b), difference(b, a)
    # The two may share edges, where the areas lay beside each other.
    polygons = overlay.areas(x.polygons, y.polygons, "union") if x.polygons and y.polygons else x.polygons or y.polygons
    return _made(x.points + [p for p in y.points if p not in x.points], x.lines + y.lines, polygons)


def bounding_circle(g: Geometry, steps: int = 64) -> Geometry:
    """The smallest circle around all coordinates, as a polygon with so many corners around it."""
    (x, y), r = overlay.smallest_circle(g.coordinates())
    if r == 0:
        return Geometry([(x, y)])
    ring = [(x + r * math.cos(2 * math.pi * i / steps), y + r * math.sin(2 * math.pi * i / steps)) for i in range(steps)]
    return Geometry(polygons=[[[*ring, ring[0]]]], kind="POLYGON")


# ---------------------------------------------------------------- columns


def _column(f: Callable[..., object], kind: str) -> Callable[..., Column]:
    """``f`` over columns; rows of a batch with the same arguments are worked out once."""

    def value(row: tuple) -> object:
        try:
            return None if any(x is None for x in row) else f(*row)
        except (ValueError, ZeroDivisionError, IndexError):
            return None

    def run(*args: pd.Series) -> pd.Series:
        known: dict[tuple, object] = {}
        out = []
        for row in zip(*args):
            if row not in known:
                known[row] = value(row)
            out.append(known[row])
        return pd.Series(out, dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return lambda *cols: F.pandas_udf(one if len(cols) == 1 else two, kind)(*cols)


def _of(f: Callable[..., object]) -> Callable[..., object]:
    """``f`` on parsed geometries; what does not parse gives null."""

    def run(*texts: object) -> object:
        gs = [parse(t) if isinstance(t, str) else t for t in texts]
        return None if any(g is None for g in gs) else f(*gs)

    return run


UNARY: dict[str, tuple[Callable[[Geometry], object], str]] = {
    "area": (area, "double"), "length": (length, "double"), "perimeter": (length, "double"),
    "centroid": (lambda g: wkt(centroid(g)), "string"), "convexHull": (lambda g: wkt(convex_hull(g)), "string"), "envelope": (lambda g: wkt(envelope(g)), "string"), "boundary": (lambda g: wkt(boundary(g)), "string"),
    "dimension": (lambda g: g.dimension(), "long"), "coordinateDimension": (lambda g: 2, "long"), "isEmpty": (Geometry.empty, "boolean"), "isSimple": (is_simple, "boolean"), "asGeoJSON": (geojson, "string"), "asWKT": (wkt, "string"), "getSRID": (lambda g: g.srid, "string"),
    "geometryType": (lambda g: g.kind, "string"), "numGeometries": (lambda g: len(g.points) + len(g.lines) + len(g.polygons), "long"),
    "minX": (lambda g: min(p[0] for p in g.coordinates()), "double"), "maxX": (lambda g: max(p[0] for p in g.coordinates()), "double"), "minY": (lambda g: min(p[1] for p in g.coordinates()), "double"), "maxY": (lambda g: max(p[1] for p in g.coordinates()), "double"),
}
BINARY: dict[str, tuple[Callable[..., object], str]] = {
    "distance": (distance, "double"), "metricDistance": (lambda a, b: distance(a, b, False), "double"), "intersection": (lambda a, b: wkt(intersection(a, b)), "string"), "union": (lambda a, b: wkt(union(a, b)), "string"), "difference": (lambda a, b: wkt(difference(a, b)), "string"), "symDifference": (lambda a, b: wkt(sym_difference(a, b)), "string"), "relate": (relate, "string"), "buffer": (lambda a, r: wkt(buffer(a, float(r))), "string"),
    **{r: (lambda a, b, r=r: relation(r, a, b), "boolean") for r in RELATIONS},
}


def function(name: str, *cols: Column) -> Column:
    """A geometry function over columns of literals."""
    if name in RELATIONS:
        return _column(partial(_named, name), "boolean")(*cols)
    f, kind = (UNARY if name in UNARY else BINARY)[name]
    return _column(_of(f), kind)(*cols)


def point_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine metres between coordinate columns, in the JVM."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """A box test that reaches the scan as range filters."""
    return (lon >= box[0]) & (lat >= box[1]) & (lon <= box[2]) & (lat <= box[3])


def nearby(df: DataFrame, lon: str, lat: str, at: Point, metres: float, limit: int | None = None, key: str | None = None) -> DataFrame:
    """Rows within ``metres``, nearest first if there is a limit; a box is tested before the distance."""
    dy = math.degrees(metres / EARTH)
    edge = min(89.999, abs(at[1]) + dy)
    dx = 180.0 if abs(at[1]) + dy >= 89.999 else min(180.0, math.degrees(math.asin(min(1.0, math.sin(min(metres / EARTH, math.pi / 2)) / math.cos(math.radians(at[1]))))) if metres / EARTH < math.radians(90 - abs(at[1])) else 180.0)
    box = F.col(lat).between(max(-90.0, at[1] - dy), min(90.0, at[1] + dy))
    del edge
    if at[0] - dx >= -180 and at[0] + dx <= 180:
        box = box & F.col(lon).between(at[0] - dx, at[0] + dx)
    out = df.where(box).withColumn("distance", point_distance(F.col(lon), F.col(lat), F.lit(at[0]), F.lit(at[1]))).where(F.col("distance") <= metres)
    return out if limit is None else out.orderBy("distance", *([key] if key else [])).limit(limit)


def spatial_join(a: DataFrame, b: DataFrame, name: str = "sfIntersects", left: str = "geom", right: str = "geom_b", cell: float = 1.0) -> DataFrame:
    """Pairs for which a relation other than a disjoint one holds; columns of both must differ."""
    if "isjoint" in name or name == "rcc8dc":
        raise ValueError("a disjoint relation has no join")

    def boxed(df: DataFrame, geom: str, mark: str) -> DataFrame:
        bound = {n: function(n, F.col(geom)) for n in ("minX", "minY", "maxX", "maxY")}
        df = df.withColumns({f"_{mark}{n}": c for n, c in bound.items()}).where(f"_{mark}minX is not null")
        side = lambda lo, hi: F.sequence(F.floor(F.col(f"_{mark}{lo}") / cell), F.floor(F.col(f"_{mark}{hi}") / cell))
        df = df.withColumn("_gx", F.explode(side("minX", "maxX")))
        return df.withColumn("_gy", F.explode(side("minY", "maxY")))

    pairs = boxed(a, left, "a").join(boxed(b, right, "b"), ["_gx", "_gy"])
    # The cell of the boxes' common lower corner is the one that tests the pair.
    first = (F.floor(F.greatest("_aminX", "_bminX") / cell) == F.col("_gx")) & (F.floor(F.greatest("_aminY", "_bminY") / cell) == F.col("_gy"))
    overlap = (F.col("_aminX") <= F.col("_bmaxX")) & (F.col("_bminX") <= F.col("_amaxX")) & (F.col("_aminY") <= F.col("_bmaxY")) & (F.col("_bminY") <= F.col("_amaxY"))
    return pairs.where(first & overlap).where(function(name, F.col(left), F.col(right))).select(*a.columns, *b.columns)


def aggregate(df: DataFrame, keys: list[str], geom: str, name: str) -> DataFrame:
    """boundingBox, boundingCircle, centroid (of points), convexHull or union of the geometries of a group.

    The box and the centroid are sums that are merged on both sides of the
    shuffle; hulls are made by partition first, so a group reaches its reducer as
    a few hulls.
    """
    if name == "boundingBox":
        parts = df.select(*keys, *[function(n, F.col(geom)).alias(n) for n in ("minX", "minY", "maxX", "maxY")])
        g = parts.groupBy(*keys).agg(F.min("minX").alias("a"), F.min("minY").alias("b"), F.max("maxX").alias("c"), F.max("maxY").alias("d"))
        return g.select(*keys, F.format_string("POLYGON((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))", *[F.col(x).cast("string") for x in "abcd"]).alias("value"))
    if name == "centroid":
        c = df.select(*keys, *[function(n, function("centroid", F.col(geom))).alias(n) for n in ("minX", "minY")])
        return c.groupBy(*keys).agg(F.format_string("POINT(%s %s)", F.avg("minX").cast("string"), F.avg("minY").cast("string")).alias("value"))
    step = {"convexHull": lambda gs: convex_hull(Geometry(points=[p for g in gs for p in g.coordinates()])), "union": lambda gs: _merge(gs)}["convexHull" if name == "boundingCircle" else name]

    def gather(rows: DataFrame, by: list[str]) -> DataFrame:
        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)

        def run(group: pd.DataFrame) -> pd.DataFrame:
            gs = [g for g in map(parse, group["_g"]) if g is not None]
            return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "_g": [wkt(step(gs)) if gs else None]})

        return rows.groupBy(*by).applyInPandas(run, f"{kinds}, _g string")

    # A hull or a union takes each geometry once.
    salted = df.select(*keys, F.col(geom).alias("_g"), F.pmod(F.xxhash64(geom), F.lit(64)).cast("int").alias("_s")).distinct()
    out = gather(gather(salted, [*keys, "_s"]).drop("_s"), keys).withColumnRenamed("_g", "value")
    # The circle around a group is the circle around its hull.
    return out if name != "boundingCircle" else out.withColumn("value", _column(_of(lambda g: wkt(bounding_circle(g))), "string")(F.col("value")))


def _merge(gs: list[Geometry]) -> Geometry:
    """The union, of neighbours first and then of their unions, so that a part is taken through few of them."""
    corner = lambda g: min(g.coordinates(), default=(math.inf, math.inf))
    gs = sorted(gs, key=corner)
    while len(gs) > 1:
        gs = [union(*pair) if len(pair) > 1 else pair[0] for pair in (gs[i : i + 2] for i in range(0, len(gs), 2))]
    return gs[0]

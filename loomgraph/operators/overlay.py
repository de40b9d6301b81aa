"""Overlay of areas, lines and points, in exact arithmetic.

Boundaries are cut where they meet, each piece is inside, outside or on the other
area's boundary, and the pieces that the operation keeps are joined to rings
again, an area always on their left.  So holes, rings that are not convex and
areas that touch come out right.
"""

from __future__ import annotations

import math
from fractions import Fraction

Number = Fraction | int
Exact = tuple[Number, Number]
Edge = tuple[Exact, Exact]
Ring = list[tuple[float, float]]


def _exact(p: tuple[float, float], scale: int = 1) -> Exact:
    x, y = Fraction(p[0]) * scale, Fraction(p[1]) * scale
    return (x.numerator, y.numerator) if x.denominator == y.denominator == 1 else (x, y)


def _scale(*areas: list[list[Ring]]) -> int:
    """A power of two that makes integers of all coordinates and of the middles between them, which are quicker than fractions; 1 if it or they are too large."""
    numbers = [x for area in areas for polygon in area for ring in polygon for p in ring for x in p]
    most = max((x.as_integer_ratio()[1] for x in numbers), default=1)
    return 2 * most if most.bit_length() < 256 and all(abs(x) < 1e200 for x in numbers) else 1


def _twice(ring: list[Exact]) -> Number:
    """Twice the signed area."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def _edges(polygons: list[list[Ring]], scale: int = 1) -> list[Edge]:
    """Directed edges with the area on their left."""
    out = []
    for polygon in polygons:
        for i, ring in enumerate(polygon):
            points = [_exact(p, scale) for p in ring]
            if points and points[0] != points[-1]:
                points.append(points[0])
            if (_twice(points) > 0) == (i > 0):
                points.reverse()
            out += [(a, b) for a, b in zip(points, points[1:]) if a != b]
    return out


def _cross(o: Exact, a: Exact, b: Exact) -> Fraction:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _between(p: Exact, a: Exact, b: Exact) -> bool:
    return _cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _boxes(edges: list[Edge]) -> list[tuple[float, float, float, float]]:
    """Each edge's box in floating point, a little wider than it is."""
    out = []
    for (x1, y1), (x2, y2) in edges:
        x1, y1, x2, y2 = float(x1), float(y1), float(x2), float(y2)
        rim = 1e-9 * max(1.0, abs(x1), abs(y1), abs(x2), abs(y2))
        out.append((min(x1, x2) - rim, max(x1, x2) + rim, min(y1, y2) - rim, max(y1, y2) + rim))
    return out


def _split(edges: list[Edge], others: list[Edge], points: tuple[Exact, ...] = ()) -> list[Edge]:
    """The edges, cut where they meet others or points."""
    out, near = [], _boxes(others)
    for (a, b), own in zip(edges, _boxes(edges)):
        at = {a, b, *(p for p in points if _between(p, a, b))}
        for (c, d), box in zip(others, near):
            if own[1] < box[0] or box[1] < own[0] or own[3] < box[2] or box[3] < own[2]:
                continue
            turn = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if turn:
                t = (c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])
                u = (c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])
                if turn < 0:
                    t, u, turn = -t, -u, -turn
                if 0 <= t <= turn and 0 <= u <= turn and t not in (0, turn):
                    if u in (0, turn):
                        at.add(d if u else c)
                    else:
                        share = Fraction(t, turn)
                        at.add((a[0] + share * (b[0] - a[0]), a[1] + share * (b[1] - a[1])))
            else:
                at.update(p for p in (c, d) if _between(p, a, b))
        order = sorted(at, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        out += list(zip(order, order[1:]))
    return out


def _place(p: Exact, edges: list[Edge], boxes: list[tuple] | None = None) -> str:
    """I, B or E: where a point lies in the area of these edges."""
    inside = False
    x, y = float(p[0]), float(p[1])
    for (a, b), box in zip(edges, boxes or _boxes(edges)):
        if y < box[2] or y > box[3] or x > box[1]:
            continue  # neither on the edge nor beside it on its left
        if x < box[0]:
            inside ^= (a[1] > p[1]) != (b[1] > p[1])
            continue
        if _between(p, a, b):
            return "B"
        if (a[1] > p[1]) != (b[1] > p[1]) and (_cross(a, b, p) > 0) == (b[1] > a[1]):
            inside = not inside
    return "I" if inside else "E"


def _half(x: Number) -> Number:
    return x >> 1 if isinstance(x, int) and not x & 1 else Fraction(x) / 2


def _middle(e: Edge) -> Exact:
    return _half(e[0][0] + e[1][0]), _half(e[0][1] + e[1][1])


def _rings(edges: list[Edge]) -> list[list[Exact]]:
    """Closed rings of directed edges, each turning as far left as it can, so that rings that touch stay apart."""
    after: dict[Exact, list[Exact]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    angle = lambda o, p: math.atan2(float(p[1] - o[1]), float(p[0] - o[0]))
    out = []
    while after:
        start = now = min(after)
        ring, before = [start], None
        while True:
            choices = after[now]
            if before is None or len(choices) == 1:
                nxt = choices[0]
            else:
                back = angle(now, before)
                nxt = min(choices, key=lambda p: (back - angle(now, p)) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
            choices.remove(nxt)
            if not choices:
                del after[now]
            before, now = now, nxt
            ring.append(now)
            if now == start and (start not in after or len(ring) > 3):
                break
        out.append(ring)
    return out


def _plain(ring: list[Exact]) -> list[Exact]:
    """Without points on a straight line."""
    points = ring[:-1]
    kept = [p for i, p in enumerate(points) if _cross(points[i - 1], p, points[(i + 1) % len(points)]) != 0]
    return [*kept, kept[0]] if kept else []


def _polygons(edges: list[Edge], scale: int = 1) -> list[list[Ring]]:
    rings = [r for r in map(_plain, _rings(edges)) if len(r) > 3]
    outer = sorted((r for r in rings if _twice(r) > 0), key=_twice)
    found: list[list[list[Exact]]] = [[r] for r in outer]
    for hole in (r for r in rings if _twice(r) < 0):
        spot = _middle((hole[0], hole[1]))
        for polygon in found:
            if _place(spot, list(zip(polygon[0], polygon[0][1:]))) != "E":
                polygon.append(hole)
                break
    return [[[(float(x / scale), float(y / scale)) for x, y in ring] for ring in polygon] for polygon in found]


def areas(a: list[list[Ring]], b: list[list[Ring]], how: str) -> list[list[Ring]]:
    """The polygons of an intersection, union or difference of two areas."""
    scale = _scale(a, b)
    ea, eb = _edges(a, scale), _edges(b, scale)
    # Rings of one area may touch, so each is cut by its own edges too.
    pa, pb = _split(ea, ea + eb), _split(eb, ea + eb)
    have = set(pb)
    boxes_a, boxes_b = _boxes(ea), _boxes(eb)
    keep: list[Edge] = []
    for p, q in pa:
        if (p, q) in have:
            if how != "difference":
                keep.append((p, q))
        elif (q, p) in have:
            if how == "difference":
                keep.append((p, q))
        elif (_place(_middle((p, q)), eb, boxes_b) == "I") == (how == "intersection"):
            keep.append((p, q))
    mine = set(pa)
    for p, q in pb:
        if (p, q) in mine or (q, p) in mine:
            continue
        inside = _place(_middle((p, q)), ea, boxes_a) == "I"
        if how == "union" and not inside:
            keep.append((p, q))
        elif how != "union" and inside:
            keep.append((p, q) if how == "intersection" else (q, p))
    return _polygons(list(dict.fromkeys(keep)), scale)


def lines_in_area(lines: list[Ring], area: list[list[Ring]], inside: bool) -> list[Ring]:
    """The parts of lines within an area (with its boundary), or outside it."""
    edges = _edges(area)
    out: list[list[Exact]] = []
    for line in lines:
        points = [_exact(p) for p in line]
        for p, q in _split([(x, y) for x, y in zip(points, points[1:]) if x != y], edges):
            if (_place(_middle((p, q)), edges) != "E") == inside:
                if out and out[-1][-1] == p:
                    out[-1].append(q)
                else:
                    out.append([p, q])
    return [[(float(x), float(y)) for x, y in part] for part in out]


def lines_on_lines(a: list[Ring], b: list[Ring], common: bool) -> tuple[list[Ring], list[tuple[float, float]]]:
    """The parts of lines that others share (and the points where they cross), or that they do not."""
    pieces = lambda lines: [(x, y) for line in lines for x, y in zip([_exact(p) for p in line], [_exact(p) for p in line][1:]) if x != y]
    ea, eb = pieces(a), pieces(b)
    pa, pb = _split(ea, eb), {frozenset(e) for e in _split(eb, ea)}
    out = [e for e in pa if (frozenset(e) in pb) == common]
    taken = {p for e in out for p in e}
    ends_b = {p for e in pb for p in e}
    points = sorted({p for e in pa for p in e} & ends_b - taken) if common else []
    back = lambda p: (float(p[0]), float(p[1]))
    return [[back(p), back(q)] for p, q in out], [back(p) for p in points]


def place(p: tuple[float, float], area: list[list[Ring]]) -> str:
    """I, B or E: where a point lies in an area."""
    return _place(_exact(p), _edges(area))


def smallest_circle(points: list[tuple[float, float]]) -> tuple[tuple[float, float], float]:
    """The smallest circle around points: grown over a shuffled list, through one, two or three of them."""
    import random

    points = sorted(set(points))
    random.Random(1).shuffle(points)
    inside = lambda c, p: c is not None and math.hypot(p[0] - c[0][0], p[1] - c[0][1]) <= c[1] * (1 + 1e-12) + 1e-12

    def two(p: tuple, q: tuple) -> tuple:
        m = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        return m, math.hypot(p[0] - m[0], p[1] - m[1])

    def three(p: tuple, q: tuple, r: tuple) -> tuple | None:
        bx, by, cx, cy = q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return None
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return (p[0] + ux, p[1] + uy), math.hypot(ux, uy)

    circle = None
    for i, p in enumerate(points):
        if inside(circle, p):
            continue
        circle = (p, 0.0)
        for j, q in enumerate(points[:i]):
            if inside(circle, q):
                continue
            circle = two(p, q)
            for r in points[:j]:
                if not inside(circle, r):
                    circle = three(p, q, r) or max((two(p, q), two(p, r), two(q, r)), key=lambda c: c[1])
    return circle or ((0.0, 0.0), 0.0)

"""Planar geometry on well-known text, in Arrow batches."""

from __future__ import annotations

import math
import re
import struct

Point = tuple[float, float]


def parse(wkt: str) -> tuple[str, list]:
    """(kind, nested lists of points)."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(EMPTY|\(.*\))\s*", wkt, re.S)
    if not m:
        raise ValueError(f"no geometry: {wkt!r}")
    kind = m[1].upper()
    if m[2].upper() == "EMPTY":
        return kind, []
    if kind == "GEOMETRYCOLLECTION":
        parts, depth, start = [], 0, 0
        body = m[2][1:-1]
        for i, c in enumerate(body + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(parse(body[start:i]))
                start = i + 1
        return kind, parts
    text = re.sub(r"(-?[\d.]+(?:[eE][+-]?\d+)?)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)", r"[\1,\2]", m[2])
    value = __import__("json").loads(re.sub(r"\(", "[", re.sub(r"\)", "]", text)))
    if kind == "POINT":
        return kind, [tuple(value[0])]
    if kind == "MULTIPOINT":
        return kind, [tuple(p[0] if isinstance(p[0], list) else p) for p in value]
    return kind, value


def show(kind: str, value: list) -> str:
    number = lambda x: f"{x:.15g}"
    point = lambda p: f"{number(p[0])} {number(p[1])}"
    ring = lambda r: "(" + ",".join(map(point, r)) + ")"
    if not value:
        return f"{kind} EMPTY"
    body = {
        "POINT": lambda: f"({point(value[0])})", "LINESTRING": lambda: ring(value), "MULTIPOINT": lambda: ring(value), "POLYGON": lambda: "(" + ",".join(map(ring, value)) + ")",
        "MULTILINESTRING": lambda: "(" + ",".join(map(ring, value)) + ")", "MULTIPOLYGON": lambda: "(" + ",".join("(" + ",".join(map(ring, p)) + ")" for p in value) + ")",
        "GEOMETRYCOLLECTION": lambda: "(" + ",".join(show(*g) for g in value) + ")",
    }
    return kind + body[kind]()


def points(g: tuple[str, list]) -> list[Point]:
    kind, v = g
    if kind in ("POINT", "LINESTRING", "MULTIPOINT"):
        return [tuple(p) for p in v]
    if kind in ("POLYGON", "MULTILINESTRING"):
        return [tuple(p) for r in v for p in r]
    if kind == "MULTIPOLYGON":
        return [tuple(p) for poly in v for r in poly for p in r]
    return [p for sub in v for p in points(sub)]


def polygons(g) -> list[list]:
    return [g[1]] if g[0] == "POLYGON" else g[1] if g[0] == "MULTIPOLYGON" else [p for x in g[1] for p in polygons(x)] if g[0] == "GEOMETRYCOLLECTION" else []


def lines(g) -> list[list]:
    if g[0] == "LINESTRING":
        return [g[1]]
    if g[0] == "MULTILINESTRING":
        return g[1]
    return [r for poly in polygons(g) for r in poly]


def ring_area(r) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2


def area(g) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in polygons(g))


def length(g) -> float:
    return sum(math.dist(a, b) for r in (lines(g) if g[0].endswith("LINESTRING") else []) for a, b in zip(r, r[1:], strict=False))


def box(g) -> tuple[float, float, float, float] | None:
    ps = points(g)
    return (min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)) if ps else None


def centroid(g) -> tuple[str, list]:
    polys = polygons(g)
    if polys:
        total = x = y = 0.0
        for p in polys:
            for k, r in enumerate(p):
                s = 1 if k == 0 else -1
                a = ring_area(r)
                cx = sum((p1[0] + p2[0]) * (p1[0] * p2[1] - p2[0] * p1[1]) for p1, p2 in zip(r, r[1:], strict=False)) / (6 * a) if a else 0
                cy = sum((p1[1] + p2[1]) * (p1[0] * p2[1] - p2[0] * p1[1]) for p1, p2 in zip(r, r[1:], strict=False)) / (6 * a) if a else 0
                total, x, y = total + s * abs(a), x + s * abs(a) * cx, y + s * abs(a) * cy
        return "POINT", [(x / total, y / total)] if total else []
    if g[0].endswith("LINESTRING"):
        n = length(g)
        if n:
            mid = lambda k: sum(math.dist(a, b) * (a[k] + b[k]) / 2 for r in lines(g) for a, b in zip(r, r[1:], strict=False)) / n
            return "POINT", [(mid(0), mid(1))]
    ps = points(g)
    return "POINT", [(sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps))] if ps else []


def on_segment(p, a, b) -> bool:
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return abs(cross) < 1e-12 and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12


def place(p, g) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    out = -1
    for poly in polygons(g):
        inside = False
        for r in poly:
            for a, b in zip(r, r[1:], strict=False):
                if on_segment(p, a, b):
                    return 0
                if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                    inside = not inside
        out = max(out, 1 if inside else -1)
    for r in lines(g) if g[0].endswith("LINESTRING") else []:
        if any(on_segment(p, a, b) for a, b in zip(r, r[1:], strict=False)):
            return 1
    if g[0] in ("POINT", "MULTIPOINT") and tuple(p) in points(g):
        return 1
    return out


def cross(a, b, c, d) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    return s1 * s2 < 0 and s3 * s4 < 0 or on_segment(c, a, b) or on_segment(d, a, b) or on_segment(a, c, d) or on_segment(b, c, d)


def segments(g) -> list[tuple]:
    return [(a, b) for r in lines(g) for a, b in zip(r, r[1:], strict=False)]


def intersects(g, h) -> bool:
    if any(place(p, h) >= 0 for p in points(g)) or any(place(p, g) >= 0 for p in points(h)):
        return True
    return any(cross(a, b, c, d) for a, b in segments(g) for c, d in segments(h))


def contains(g, h) -> bool:
    spots = [place(p, g) for p in points(h)]
    middles = [place(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), g) for a, b in segments(h)]
    return bool(spots) and all(s >= 0 for s in spots + middles) and (any(s == 1 for s in spots + middles) or bool(polygons(h)))


def distance(g, h) -> float | None:
    if intersects(g, h):
        return 0.0
    ps, qs = points(g), points(h)
    if not ps or not qs:
        return None

    def to_segment(p, a, b):
        n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n)) if n else 0
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    return min([math.dist(p, q) for p in ps for q in qs] + [to_segment(p, a, b) for p in ps for a, b in segments(h)] + [to_segment(q, a, b) for q in qs for a, b in segments(g)])


def crosses(g, h) -> bool:
    """Whether the insides meet, in less than the larger of both dimensions, and neither holds the other."""
    if dimension(g) > dimension(h):
        return crosses(h, g)
    spots = [place(p, h) for p in points(g)] + [place(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), h) for a, b in segments(g)]
    if dimension(g) < dimension(h):
        return 1 in spots and -1 in spots or any(_properly(a, b, c, d) for a, b in segments(g) for c, d in segments(h)) and not contains(h, g)
    if dimension(g) == 1:
        return any(_properly(a, b, c, d) for a, b in segments(g) for c, d in segments(h))
    return False


def _properly(a, b, c, d) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def overlaps(g, h) -> bool:
    """Whether two geometries of one dimension share inside points and neither holds the other."""
    if dimension(g) != dimension(h) or contains(g, h) or contains(h, g):
        return False
    if dimension(g) == 0:
        return bool(set(points(g)) & set(points(h)))
    if dimension(g) == 2:
        return any(place(p, h) == 1 for p in points(g)) or any(place(p, g) == 1 for p in points(h)) or any(_properly(a, b, c, d) for a, b in segments(g) for c, d in segments(h))
    middles = lambda x: [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in segments(x)]
    return any(place(p, h) >= 0 for p in middles(g)) or any(place(p, g) >= 0 for p in middles(h))


def dimension(g) -> int:
    if g[0] == "GEOMETRYCOLLECTION":
        return max(map(dimension, g[1]), default=0)
    return 2 if g[0].endswith("POLYGON") else 1 if g[0].endswith("LINESTRING") else 0


def touches(g, h) -> bool:
    """Whether they meet, but only where at least one of them ends."""
    if dimension(g) > dimension(h):
        return touches(h, g)
    if dimension(g) == 0:
        ends = {tuple(p) for r in lines(h) if tuple(r[0]) != tuple(r[-1]) for p in (r[0], r[-1])} if dimension(h) == 1 else set()
        where = [0 if tuple(p) in ends else place(p, h) for p in points(g)]
        return dimension(h) > 0 and 0 in where and 1 not in where
    inside = any(place(p, h) == 1 for p in points(g)) or any(place(p, g) == 1 for p in points(h)) if dimension(h) == 2 else any(_properly(a, b, c, d) for a, b in segments(g) for c, d in segments(h))
    return intersects(g, h) and not inside


# Codes of kinds in well-known binary.
CODES = ["POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION"]


def to_wkb(g) -> bytes:
    kind, v = g
    pairs = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    if kind == "POINT":
        body = struct.pack("<dd", *v[0])
    elif kind == "LINESTRING":
        body = pairs(v)
    elif kind == "POLYGON":
        body = struct.pack("<I", len(v)) + b"".join(map(pairs, v))
    else:
        parts = v if kind == "GEOMETRYCOLLECTION" else [(kind.removeprefix("MULTI"), [p] if kind == "MULTIPOINT" else p) for p in v]
        body = struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts))
    return b"\x01" + struct.pack("<I", CODES.index(kind) + 1) + body


def from_wkb(data: bytes) -> tuple[str, list]:
    return _read_wkb(data, 0)[0]


def _read_wkb(data: bytes, at: int) -> tuple[tuple[str, list], int]:
    order = "<" if data[at] else ">"

    def read(form: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    at += 1
    kind = CODES[read("I")[0] - 1]
    if kind == "POINT":
        return (kind, [read("dd")]), at
    if kind == "LINESTRING":
        return (kind, [read("dd") for _ in range(read("I")[0])]), at
    if kind == "POLYGON":
        return (kind, [[read("dd") for _ in range(read("I")[0])] for _ in range(read("I")[0])]), at
    parts = []
    for _ in range(read("I")[0]):
        part, at = _read_wkb(data, at)
        parts.append(part)
    return (kind, parts if kind == "GEOMETRYCOLLECTION" else [p[1][0] if kind == "MULTIPOINT" else p[1] for p in parts]), at


def boxes(f):
    def g(a, b):
        x, y = box(a), box(b)
        return None if x is None or y is None else f(x, y)

    return g


def _holds(x, y) -> bool:
    return x[0] <= y[0] and x[1] <= y[1] and x[2] >= y[2] and x[3] >= y[3]


#: name -> (function of one or two geometries, kind of result)
ONE = {
    "area": (area, "n"), "length": (length, "n"), "glength": (length, "n"), "perimeter": (lambda g: sum(math.dist(a, b) for a, b in segments(g)) if polygons(g) else 0.0, "n"), "centroid": (lambda g: show(*centroid(g)), "s"),
    "envelope": (lambda g: (lambda b: show("POLYGON", [[(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]]) if b else show("POLYGON", []))(box(g)), "s"), "x": (lambda g: g[1][0][0] if g[0] == "POINT" and g[1] else None, "n"), "y": (lambda g: g[1][0][1] if g[0] == "POINT" and g[1] else None, "n"),
    "numpoints": (lambda g: float(len(points(g))), "n"), "numgeometries": (lambda g: float(len(g[1]) if g[0].startswith(("MULTI", "GEOMETRYC")) else 1), "n"), "geometrytype": (lambda g: g[0], "s"), "dimension": (lambda g: float(2 if polygons(g) else 1 if "LINE" in g[0] else 0), "n"),
    "srid": (lambda g: 0.0, "n"), "numinteriorring": (lambda g: float(len(g[1]) - 1), "n"),
    "isempty": (lambda g: float(not points(g)), "n"), "isclosed": (lambda g: float(all(tuple(r[0]) == tuple(r[-1]) for r in lines(g))), "n"), "startpoint": (lambda g: show("POINT", [g[1][0]]), "s"), "endpoint": (lambda g: show("POINT", [g[1][-1]]), "s"),
    "exteriorring": (lambda g: show("LINESTRING", g[1][0]), "s"), "numinteriorrings": (lambda g: float(len(g[1]) - 1), "n"), "astext": (lambda g: show(*g), "s"), "aswkt": (lambda g: show(*g), "s"), "issimple": (lambda g: float(len({tuple(p) for p in points(g)}) >= len(points(g)) - len(lines(g))), "n"),
}
TWO = {
    "contains": (lambda g, h: float(contains(g, h)), "n"), "within": (lambda g, h: float(contains(h, g)), "n"), "intersects": (lambda g, h: float(intersects(g, h)), "n"), "disjoint": (lambda g, h: float(not intersects(g, h)), "n"), "distance": (distance, "n"),
    "equals": (lambda g, h: float(contains(g, h) and contains(h, g) if polygons(g) or lines(g) else sorted(points(g)) == sorted(points(h))), "n"), "touches": (lambda g, h: float(touches(g, h)), "n"),
    "crosses": (lambda g, h: float(crosses(g, h)), "n"), "overlaps": (lambda g, h: float(overlaps(g, h)), "n"),
    "mbroverlaps": (boxes(lambda x, y: float(x != y and x[0] < y[2] and y[0] < x[2] and x[1] < y[3] and y[1] < x[3] and not _holds(x, y) and not _holds(y, x))), "n"),
    "mbrtouches": (boxes(lambda x, y: float(x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3] and not (x[0] < y[2] and y[0] < x[2] and x[1] < y[3] and y[1] < x[3]))), "n"),
    "mbrcontains": (boxes(lambda x, y: float(x[0] <= y[0] and x[1] <= y[1] and x[2] >= y[2] and x[3] >= y[3])), "n"), "mbrwithin": (boxes(lambda x, y: float(y[0] <= x[0] and y[1] <= x[1] and y[2] >= x[2] and y[3] >= x[3])), "n"), "mbrequal": (boxes(lambda x, y: float(x == y)), "n"), "mbrequals": (boxes(lambda x, y: float(x == y)), "n"),
    "mbrintersects": (boxes(lambda x, y: float(x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3])), "n"), "mbrdisjoint": (boxes(lambda x, y: float(not (x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3]))), "n"),
}
NTH = {
    "pointn": lambda g, n: show("POINT", [g[1][n - 1]]) if 1 <= n <= len(g[1]) else None, "geometryn": lambda g, n: show(g[0].removeprefix("MULTI"), [g[1][n - 1]] if g[0] == "MULTIPOINT" else g[1][n - 1]) if 1 <= n <= len(g[1]) else None,
    "interiorringn": lambda g, n: show("LINESTRING", g[1][n]) if 1 <= n < len(g[1]) else None,
}
SAME = ["geomfromtext", "geometryfromtext", "pointfromtext", "linefromtext", "linestringfromtext", "polyfromtext", "polygonfromtext", "mpointfromtext", "mlinefromtext", "mpolyfromtext", "multipointfromtext", "multilinestringfromtext", "multipolygonfromtext", "geomcollfromtext", "geomcollfromtxt", "geometrycollectionfromtext", "multilinefromtext"]
#: Names that read and write well-known binary.
FROM_WKB = ["geomfromwkb", "geometryfromwkb", "pointfromwkb", "linefromwkb", "linestringfromwkb", "polyfromwkb", "polygonfromwkb", "mpointfromwkb", "mlinefromwkb", "mpolyfromwkb", "multipointfromwkb", "multilinestringfromwkb", "multipolygonfromwkb", "geomcollfromwkb", "geometrycollectionfromwkb"]
TO_WKB = ["asbinary", "aswkb"]

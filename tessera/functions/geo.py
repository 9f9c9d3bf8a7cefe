"""Distances and containment of GeoJSON values as Columns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scope import PipelineError, Scope, Typed, path

#: Fixed value: the earth's radius in metres.
EARTH = 6_378_100.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def vertices(value: Typed) -> Column:
    """All vertices of a geometry as an array of [lon, lat]. A plain pair of numbers is a point too."""
    kind, c = value.type, value.column
    if isinstance(kind, T.StructType) and "coordinates" in kind.names:
        kind, c = kind["coordinates"].dataType, c.getField("coordinates")
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    if not depth:
        raise PipelineError("not a geometry")
    if depth == 1:
        return F.when(F.size(c) >= 2, F.array(c.cast("array<double>")))
    for _ in range(depth - 2):
        c = F.flatten(c)
    return c.cast("array<array<double>>")


def distance(value: Typed, lon: float, lat: float) -> Column:
    """Metres to the nearest vertex."""
    return F.array_min(F.transform(vertices(value), lambda p: haversine(F.get(p, 0), F.get(p, 1), F.lit(float(lon)), F.lit(float(lat)))))


def _in_ring(x: Column, y: Column, ring: list) -> Column:
    """Ray casting: an odd number of edges to the right; points on an edge count as inside."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        x1, y1, x2, y2 = float(x1), float(y1), float(x2), float(y2)
        if y1 != y2:
            at = (y - y1) / (y2 - y1) * (x2 - x1) + x1
            crossings = crossings + F.when(((y < y1) != (y < y2)) & (x < at), 1).otherwise(0)
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return on_edge | (crossings % 2 == 1)


class Shape:
    """A geometry of a query: its points, the segments of its lines, and its polygons as lists of rings."""

    def __init__(self, geometry: dict):
        self.points: list[list] = []
        self.segments: list[tuple[list, list]] = []
        self.polygons: list[list] = []
        self._add(geometry)

    def _add(self, geometry: dict) -> None:
        kind, at = geometry["type"], geometry.get("coordinates")
        if kind == "Point":
            self.points.append(at)
        elif kind == "MultiPoint":
            self.points += at
        elif kind in ("LineString", "MultiLineString"):
            for line in [at] if kind == "LineString" else at:
                self.segments += list(zip(line, line[1:], strict=False))
        elif kind in ("Polygon", "MultiPolygon"):
            self.polygons += [at] if kind == "Polygon" else at
        elif kind == "GeometryCollection":
            for part in geometry["geometries"]:
                self._add(part)
        else:
            raise PipelineError(f"unsupported geometry {kind}")

    @property
    def borders(self) -> list[tuple[list, list]]:
        return [(a, b) for rings in self.polygons for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a != b]

    @property
    def holes(self) -> list[tuple[float, float]]:
        """A point inside each hole."""
        return [_inner_point(ring) for _, *holes in self.polygons for ring in holes]

    def corners(self) -> list[list]:
        return [*self.points, *[p for s in self.segments for p in s], *[p for rings in self.polygons for ring in rings for p in ring]]

    def holds(self, x: Column, y: Column) -> Column:
        """Whether a polygon has the point, on its outer border too; a hole takes its border with it."""
        inside = [reduce(lambda a, hole: a & ~_in_ring(x, y, hole), holes, _in_ring(x, y, outer)) for outer, *holes in self.polygons]
        return reduce(lambda a, b: a | b, inside, F.lit(False))


def _inner_point(ring: list) -> tuple[float, float]:
    """A point inside a ring: in the middle between its first two borders on a height where it has no corner."""
    heights = sorted({p[1] for p in ring})
    y = (heights[0] + heights[min(1, len(heights) - 1)]) / 2
    found = sorted(x1 + (y - y1) / (y2 - y1) * (x2 - x1) for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True) if (y1 < y) != (y2 < y))
    return ((found[0] + found[1]) / 2, y) if found else tuple(ring[0])


def _cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on(x, y, ax, ay, bx, by) -> Column:
    """Whether a point lies on the segment from a to b."""
    return (_cross(ax, ay, bx, by, x, y) == 0) & (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))


def _ends(e: Column) -> tuple[Column, Column, Column, Column]:
    p, q = e["p"], e["q"]
    return F.get(p, 0), F.get(p, 1), F.get(q, 0), F.get(q, 1)


def edges(value: Typed) -> Column:
    """The segments of a geometry as an array of (p, q), never from one ring or part to the next; none for points."""
    kind, c, points = value.type, value.column, F.lit(False)
    if isinstance(kind, T.StructType) and "coordinates" in kind.names:
        if "type" in kind.names:
            points = F.coalesce(c.getField("type") == "MultiPoint", F.lit(False))
        kind, c = kind["coordinates"].dataType, c.getField("coordinates")
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    none = F.array().cast("array<struct<p:array<double>,q:array<double>>>")
    if depth < 2:
        return none

    def of_path(path: Column) -> Column:
        path = path.cast("array<array<double>>")
        n = F.size(path) - 1
        return F.when(n > 0, F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).otherwise(none)

    for _ in range(depth - 3):
        c = F.flatten(c)
    made = of_path(c) if depth == 2 else F.flatten(F.transform(c, of_path))
    return F.when(points, none).otherwise(F.coalesce(made, none))


def _is_area(value: Typed) -> Column:
    kind = value.type
    if isinstance(kind, T.StructType) and "coordinates" in kind.names:
        if "type" in kind.names:
            return F.coalesce(value.column.getField("type").isin("Polygon", "MultiPolygon"), F.lit(False))
        kind = kind["coordinates"].dataType
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return F.lit(depth >= 3)


def _area_has(found: Column, x: float, y: float) -> Column:
    """Whether the area within the edges ``found`` holds a point: an odd number of them to its right, over all rings and parts."""
    def right(e: Column) -> Column:
        x1, y1, x2, y2 = _ends(e)
        return ((F.lit(y) < y1) != (F.lit(y) < y2)) & (F.lit(x) < (F.lit(y) - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1) + x1)

    return F.size(F.filter(found, lambda e: F.coalesce(right(e), F.lit(False)))) % 2 == 1


def within(name: str, spec: dict, s: Scope) -> Column:
    """Every vertex inside, no edge that leaves in between, and no hole of the query inside an area."""
    value = path(name, s)
    if "$geometry" in spec:
        shape = Shape(spec["$geometry"])
        if not shape.polygons:
            raise PipelineError("$geoWithin needs a Polygon or a MultiPolygon")
        inside = F.forall(vertices(value), lambda p: shape.holds(F.get(p, 0), F.get(p, 1)))
        found = edges(value)

        def stays(e: Column) -> Column:
            px, py, qx, qy = _ends(e)
            out = ~shape.holds((px + qx) / 2, (py + qy) / 2)
            for a, b in shape.borders:
                ax, ay, bx, by = (F.lit(float(v)) for v in (*a, *b))
                out = out | ((F.signum(_cross(px, py, qx, qy, ax, ay)) * F.signum(_cross(px, py, qx, qy, bx, by)) < 0) & (F.signum(_cross(ax, ay, bx, by, px, py)) * F.signum(_cross(ax, ay, bx, by, qx, qy)) < 0))
            return ~out

        made = inside & F.forall(found, stays)
        for x, y in shape.holes:
            made = made & ~(_is_area(value) & _area_has(found, float(x), float(y)))
        return F.coalesce(made, F.lit(False))
    if "$centerSphere" in spec:
        (lon, lat), radians = spec["$centerSphere"]
        far = F.array_max(F.transform(vertices(value), lambda p: haversine(F.get(p, 0), F.get(p, 1), F.lit(float(lon)), F.lit(float(lat)))))
        return F.coalesce(far <= radians * EARTH, F.lit(False))
    if "$box" in spec:
        (x1, y1), (x2, y2) = spec["$box"]
        return F.coalesce(F.forall(vertices(value), lambda p: F.get(p, 0).between(x1, x2) & F.get(p, 1).between(y1, y2)), F.lit(False))
    if "$polygon" in spec:
        return within(name, {"$geometry": {"type": "Polygon", "coordinates": [spec["$polygon"]]}}, s)
    raise PipelineError("$geoWithin needs $geometry, $centerSphere, $box or $polygon")


def intersects(name: str, spec: dict, s: Scope) -> Column:
    """A shared point of any kind: vertices, edges that meet, a vertex in an area of the query, or a corner of the query in an area."""
    shape, value = Shape(spec["$geometry"]), path(name, s)
    points, found = vertices(value), edges(value)
    lines = [*shape.segments, *shape.borders]

    def touched(p: Column) -> Column:
        x, y = F.get(p, 0), F.get(p, 1)
        made = shape.holds(x, y)
        for a, b in shape.segments:
            made = made | _on(x, y, *(F.lit(float(v)) for v in (*a, *b)))
        for a in shape.points:
            made = made | ((x == float(a[0])) & (y == float(a[1])))
        return made

    def met(e: Column) -> Column:
        px, py, qx, qy = _ends(e)
        made = F.lit(False)
        for a, b in lines:
            ax, ay, bx, by = (F.lit(float(v)) for v in (*a, *b))
            apart = (F.signum(_cross(px, py, qx, qy, ax, ay)) * F.signum(_cross(px, py, qx, qy, bx, by)) < 0) & (F.signum(_cross(ax, ay, bx, by, px, py)) * F.signum(_cross(ax, ay, bx, by, qx, qy)) < 0)
            made = made | apart | _on(px, py, ax, ay, bx, by) | _on(qx, qy, ax, ay, bx, by) | _on(ax, ay, px, py, qx, qy) | _on(bx, by, px, py, qx, qy)
        for a in shape.points:
            made = made | _on(F.lit(float(a[0])), F.lit(float(a[1])), px, py, qx, qy)
        return made

    touches = F.exists(points, touched) | F.exists(found, met)
    for x, y in shape.corners():
        touches = touches | (_is_area(value) & _area_has(found, float(x), float(y)))
    return F.coalesce(touches, F.lit(False))


def near(name: str, spec: Any, s: Scope, siblings: dict) -> Column:
    """Only the band of distances; it doesn't sort."""
    if isinstance(spec, dict):
        lon, lat = spec["$geometry"]["coordinates"]
        limits = spec
    else:
        (lon, lat), limits = spec, siblings
    d = distance(path(name, s), lon, lat)
    keep = d.isNotNull()
    if "$maxDistance" in limits:
        keep = keep & (d <= float(limits["$maxDistance"]))
    if "$minDistance" in limits:
        keep = keep & (d >= float(limits["$minDistance"]))
    return F.coalesce(keep, F.lit(False))

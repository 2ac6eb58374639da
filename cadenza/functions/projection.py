"""Map projections as Column expressions: degrees of latitude and longitude (WGS84) to metres east and north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ellipsoids (half axes in metres), the national grid of Great Britain and the conic grid of France
WGS84, AIRY, GRS80 = (6378137.0, 6356752.3142), (6377563.396, 6356256.909), (6378137.0, 6356752.314140356)
#: WGS84 to the British datum: shifts in metres, rotations in seconds of arc, scale in parts per million.
OSGB_SHIFT = (-446.448, 125.157, -542.060, -0.1502, -0.2470, -0.8421, 20.4894)
OSGB = {"lat0": 49.0, "lon0": -2.0, "scale": 0.9996012717, "east": 400_000.0, "north": -100_000.0}
LAMBERT_93 = {"lat0": 46.5, "lon0": 3.0, "lat1": 44.0, "lat2": 49.0, "east": 700_000.0, "north": 6_600_000.0}
EPSG_WGS84, EPSG_OSGB, EPSG_LAMBERT_93 = 4326, 27700, 2154


def _squares(axes: tuple[float, float]) -> tuple[float, float]:
    """Long half axis and squared eccentricity."""
    a, b = axes
    return a, 1 - b * b / (a * a)


def bound(expressions: dict[str, Column]) -> Column:
    """A struct whose fields are computed once, however often they are used after."""
    return F.transform(F.array(F.struct(*[x.alias(k) for k, x in expressions.items()])), lambda v: v)[0]


def osgb_datum(lat: Column, lon: Column) -> dict[str, Column]:
    """p, q: latitude and longitude (radians) on the British datum, of a point at height 0, to some metres."""
    (a, e2), (a2, f2), b2 = _squares(WGS84), _squares(AIRY), AIRY[1]
    p, q = F.radians(lat), F.radians(lon)
    nu = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    x, y, z = nu * F.cos(p) * F.cos(q), nu * F.cos(p) * F.sin(q), nu * (1 - e2) * F.sin(p)
    tx, ty, tz, *turns, ppm = OSGB_SHIFT
    (rx, ry, rz), k = (math.radians(r / 3600) for r in turns), 1 + ppm * 1e-6
    x, y, z = tx + k * x - rz * y + ry * z, ty + rz * x + k * y - rx * z, tz - ry * x + rx * y + k * z
    r, ep2 = F.sqrt(x * x + y * y), f2 / (1 - f2)
    th = F.atan2(z * a2, r * b2)  # near the ground one step is exact to less than a millimetre
    return {"p": F.atan2(z + ep2 * b2 * F.pow(F.sin(th), 3), r - f2 * a2 * F.pow(F.cos(th), 3)), "q": F.atan2(y, x)}


def transverse_mercator(p: Column, q: Column) -> dict[str, Column]:
    """x, y on the British grid of radians on its datum."""
    (a, e2), b, f0 = _squares(AIRY), AIRY[1], OSGB["scale"]
    n, d, m, east = (a - b) / (a + b), p - math.radians(OSGB["lat0"]), p + math.radians(OSGB["lat0"]), q - math.radians(OSGB["lon0"])
    s, c, t2 = F.sin(p), F.cos(p), F.pow(F.tan(p), 2)
    nu, rho = a * f0 / F.sqrt(1 - e2 * s * s), a * f0 * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    eta2 = nu / rho - 1
    series = (1 + n + 1.25 * n * n + 1.25 * n**3, 3 * n + 3 * n * n + 2.625 * n**3, 1.875 * n * n + 1.875 * n**3, 35 / 24 * n**3)
    arc = b * f0 * (series[0] * d - series[1] * F.sin(d) * F.cos(m) + series[2] * F.sin(2 * d) * F.cos(2 * m) - series[3] * F.sin(3 * d) * F.cos(3 * m))
    x = OSGB["east"] + nu * c * east + nu / 6 * F.pow(c, 3) * (nu / rho - t2) * F.pow(east, 3) + nu / 120 * F.pow(c, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * F.pow(east, 5)
    y = arc + OSGB["north"] + nu / 2 * s * c * F.pow(east, 2) + nu / 24 * s * F.pow(c, 3) * (5 - t2 + 9 * eta2) * F.pow(east, 4) + nu / 720 * s * F.pow(c, 5) * (61 - 58 * t2 + t2 * t2) * F.pow(east, 6)
    return {"x": x, "y": y}


def conic_constants() -> tuple[float, float, float, float]:
    """Eccentricity, exponent and factor of the French grid, and the north of its pole."""
    (a, e2), g = _squares(GRS80), LAMBERT_93
    e = math.sqrt(e2)
    iso = lambda v: math.log(math.tan(math.pi / 4 + v / 2) * ((1 - e * math.sin(v)) / (1 + e * math.sin(v))) ** (e / 2))
    wide = lambda v: a / math.sqrt(1 - e2 * math.sin(v) ** 2) * math.cos(v)
    p0, p1, p2 = (math.radians(g[k]) for k in ("lat0", "lat1", "lat2"))
    n = math.log(wide(p2) / wide(p1)) / (iso(p1) - iso(p2))
    c = wide(p1) / n * math.exp(n * iso(p1))
    return e, n, c, g["north"] + c * math.exp(-n * iso(p0))


def conic(lat: Column, lon: Column) -> dict[str, Column]:
    """x, y on the French grid, whose datum is WGS84's to less than a metre."""
    e, n, c, pole = conic_constants()
    p = F.radians(lat)
    s = e * F.sin(p)
    r = c * F.exp(-n * (F.log(F.tan(math.pi / 4 + p / 2)) + e / 2 * F.log((1 - s) / (1 + s))))
    turn = n * F.radians(lon - LAMBERT_93["lon0"])
    return {"x": LAMBERT_93["east"] + r * F.sin(turn), "y": pole - r * F.cos(turn)}


def british_grid(lat: Column, lon: Column) -> Column:
    """Struct of x and y on the British grid."""
    return F.transform(F.array(bound(osgb_datum(lat, lon))), lambda v: F.struct(*[x.alias(k) for k, x in transverse_mercator(v["p"], v["q"]).items()]))[0]


def projected(lat: Column, lon: Column, epsg: int) -> Column:
    """Struct of x and y of WGS84 degrees in one of the three systems that tiles come in."""
    if epsg == EPSG_WGS84:
        return F.struct(lon.alias("x"), lat.alias("y"))
    if epsg == EPSG_OSGB:
        return british_grid(lat, lon)
    if epsg == EPSG_LAMBERT_93:
        return F.struct(*[x.alias(k) for k, x in conic(lat, lon).items()])
    raise ValueError(f"no projection for EPSG:{epsg}; known: {EPSG_WGS84}, {EPSG_OSGB}, {EPSG_LAMBERT_93}")

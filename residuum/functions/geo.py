"""Coordinate projections as column expressions.

The Transverse Mercator forward series (Snyder, *Map Projections — A Working
Manual*, USGS PP 1395, eqs. 8-9..8-15) is written once against a tiny math
backend so the same expression tree can be built from Spark ``Column``s, from
plain Python floats (tests) or from SQL text (the DuckDB oracle). All powers
are written as products so every backend evaluates the same operations in the
same order.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.constants import LOCAL_TM, WEB_MERCATOR_R, WGS84_A, WGS84_F

DEG = math.pi / 180.0

SPARK_MATH = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, sqrt=F.sqrt, ln=F.log)
PY_MATH = SimpleNamespace(sin=math.sin, cos=math.cos, tan=math.tan, sqrt=math.sqrt, ln=math.log)


def _tm_constants(params: dict, a: float = WGS84_A, f: float = WGS84_F) -> dict:
    e2 = 2 * f - f * f
    e4, e6 = e2 * e2, e2 * e2 * e2
    m1 = 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256
    m2 = 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024
    m3 = 15 * e4 / 256 + 45 * e6 / 1024
    m4 = 35 * e6 / 3072
    phi0 = params["lat0"] * DEG
    m0 = a * (m1 * phi0 - m2 * math.sin(2 * phi0) + m3 * math.sin(4 * phi0) - m4 * math.sin(6 * phi0))
    return dict(a=a, e2=e2, ep2=e2 / (1 - e2), m1=m1, m2=m2, m3=m3, m4=m4, m0=m0,
                lon0=params["lon0"], k0=params["k0"],
                fe=params["false_easting"], fn=params["false_northing"])


def _same(**named):
    return list(named.values())


def tm_forward(lon, lat, m=SPARK_MATH, params: dict = LOCAL_TM, bind=_same):
    """(easting, northing) in metres for lon/lat degrees, on any math backend.

    ``bind(**named)`` may turn one layer of intermediates into references (the
    Spark version binds each layer as columns so each value is computed once).
    """
    c = _tm_constants(params)
    phi, = bind(phi=lat * DEG)
    s, co, t = bind(s=m.sin(phi), co=m.cos(phi), t=m.tan(phi))
    nu, tt, cc, aa = bind(nu=c["a"] / m.sqrt(1.0 - c["e2"] * s * s), tt=t * t, cc=c["ep2"] * co * co,
                          aa=(lon - c["lon0"]) * DEG * co)
    aa2, = bind(aa2=aa * aa)
    aa3, aa4 = bind(aa3=aa2 * aa, aa4=aa2 * aa2)
    aa5 = aa4 * aa
    aa6 = aa3 * aa3
    mer = c["a"] * (c["m1"] * phi - c["m2"] * m.sin(2.0 * phi)
                    + c["m3"] * m.sin(4.0 * phi) - c["m4"] * m.sin(6.0 * phi))
    x = c["k0"] * nu * (aa + (1.0 - tt + cc) * aa3 / 6.0
                        + (5.0 - 18.0 * tt + tt * tt + 72.0 * cc - 58.0 * c["ep2"]) * aa5 / 120.0)
    y = c["k0"] * (mer - c["m0"] + nu * t * (
        aa2 / 2.0 + (5.0 - tt + 9.0 * cc + 4.0 * cc * cc) * aa4 / 24.0
        + (61.0 - 58.0 * tt + tt * tt + 600.0 * cc - 330.0 * c["ep2"]) * aa6 / 720.0))
    return c["fe"] + x, c["fn"] + y


def web_mercator(lon, lat, m=SPARK_MATH, r: float = WEB_MERCATOR_R):
    """Spherical web-mercator metres."""
    return r * (lon * DEG), r * m.ln(m.tan(math.pi / 4.0 + lat * DEG / 2.0))


class _ColumnBinder:
    """Adds each layer of bound intermediates as temporary columns of the frame."""

    def __init__(self, df: DataFrame, prefix: str):
        self.df, self.prefix, self.names = df, prefix, []

    def __call__(self, **named: Column) -> list[Column]:
        cols = {f"{self.prefix}{k}": v for k, v in named.items()}
        self.df = self.df.withColumns(cols)
        self.names.extend(cols)
        return [F.col(n) for n in cols]


def project_local_m(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                    x: str = "x", y: str = "y", params: dict = LOCAL_TM) -> DataFrame:
    """Add projected metre columns ``x``/``y`` (built-in expressions, codegen'd).

    Shared intermediates are bound as temporary columns: Catalyst keeps an
    expensive expression that is referenced several times in its own
    projection instead of inlining copies, so the generated code stays small.
    """
    b = _ColumnBinder(df, f"_tm_{x}_")
    ex, ny = tm_forward(F.col(lon), F.col(lat), SPARK_MATH, params, bind=b)
    return b.df.withColumns({x: ex, y: ny}).drop(*b.names)


def project_web_mercator(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                         x: str = "mx", y: str = "my") -> DataFrame:
    mx, my = web_mercator(F.col(lon), F.col(lat), SPARK_MATH)
    return df.withColumns({x: mx, y: my})


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column,
                     x2: Column, y2: Column) -> Column:
    """Euclidean distance from a point to a segment (degenerate segments allowed)."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    qx, qy = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(qx * qx + qy * qy)

"""DuckDB SQL text mirroring each registered query (the correctness oracle).

Tables ``orders nation supplier customer part documents pages ...`` are views
in the checking database. Fixture views are inlined as CTEs. Projection maths
is generated from the same Python formula as the engine's column expressions
(``functions.geo.tm_forward``) through a SQL-text backend, so both engines run
the same operations in the same order. Doubles that pass through
transcendental functions or long sums are rounded on both sides.
"""

from __future__ import annotations

from types import SimpleNamespace

from residuum.functions import constants as K
from residuum.functions.geo import tm_forward, web_mercator


class Q:
    """SQL expression text with Python arithmetic operators."""

    def __init__(self, s: str):
        self.s = s

    @staticmethod
    def w(v) -> "Q":
        return v if isinstance(v, Q) else Q(f"CAST({float(v)!r} AS DOUBLE)")

    def _b(self, op, o, rev=False):
        a, b = (Q.w(o), self) if rev else (self, Q.w(o))
        return Q(f"({a.s} {op} {b.s})")

    __add__ = lambda s, o: s._b("+", o)
    __radd__ = lambda s, o: s._b("+", o, True)
    __sub__ = lambda s, o: s._b("-", o)
    __rsub__ = lambda s, o: s._b("-", o, True)
    __mul__ = lambda s, o: s._b("*", o)
    __rmul__ = lambda s, o: s._b("*", o, True)
    __truediv__ = lambda s, o: s._b("/", o)
    __rtruediv__ = lambda s, o: s._b("/", o, True)

    def __str__(self):
        return self.s


SQL_MATH = SimpleNamespace(sin=lambda x: Q(f"sin({x})"), cos=lambda x: Q(f"cos({x})"),
                           tan=lambda x: Q(f"tan({x})"), sqrt=lambda x: Q(f"sqrt({x})"),
                           ln=lambda x: Q(f"ln({x})"))


def tm_sql(lon: str, lat: str) -> tuple[str, str]:
    x, y = tm_forward(Q(lon), Q(lat), SQL_MATH)
    return str(x), str(y)


def wm_sql(lon: str, lat: str) -> tuple[str, str]:
    x, y = web_mercator(Q(lon), Q(lat), SQL_MATH)
    return str(x), str(y)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# fixture views
# ---------------------------------------------------------------------------

VENUES = """SELECT o_orderkey AS venue_id,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL
       WHEN o_orderkey % 4 = 0 THEN concat('venue ', CAST(o_custkey AS VARCHAR))
       ELSE concat('venue ', CAST(1000000 + o_orderkey - o_orderkey % 2 AS VARCHAR)) END AS name,
  CAST(10 + (o_orderkey * 31) % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS rating,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 613) % 700 END AS BIGINT) AS review_count,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL
       ELSE concat('C', CAST((o_custkey * o_custkey) % 97 AS VARCHAR)) END AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN '$$$$' WHEN '2-HIGH' THEN '$$$' WHEN '3-MEDIUM' THEN '$$'
       WHEN '4-NOT SPECIFIED' THEN '$' ELSE NULL END AS price_level,
  CASE WHEN o_orderkey % 10 = 0 THEN 'https://maps.example/none'
       ELSE concat('https://maps.example/p!3d1.', lpad(CAST(13000 + (o_orderkey * 104729) % 36000 AS VARCHAR), 5, '0'),
                   '!4d103.', lpad(CAST(55000 + (o_orderkey * 7919) % 45000 AS VARCHAR), 5, '0')) END AS url,
  CAST(10355000 + (o_orderkey * 7919) % 55000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude,
  CAST(113000 + (o_orderkey * 104729) % 36000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS latitude
FROM orders"""

AREAS = """SELECT concat('AREA ', CAST(n_nationkey AS VARCHAR)) AS area, CAST(n_nationkey AS BIGINT) AS area_ord,
  CAST(10360 + (n_nationkey % 5) * 9 AS DOUBLE) / CAST(100 AS DOUBLE) AS x0,
  CAST(10368 + (n_nationkey % 5) * 9 AS DOUBLE) / CAST(100 AS DOUBLE) AS x1,
  CAST(1200 + CAST(floor(n_nationkey / 5.0) AS BIGINT) * 50 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y0,
  CAST(1245 + CAST(floor(n_nationkey / 5.0) AS BIGINT) * 50 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y1
FROM nation"""

ANCHORS = """SELECT s_suppkey AS anchor_id,
  CAST(10360000 + (s_suppkey * 7919) % 45000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude,
  CAST(115000 + (s_suppkey * 104729) % 30000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS latitude
FROM supplier"""

_VX, _VY = tm_sql("longitude", "latitude")


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{b}\n)" for n, b in ctes) + "\n"


V = ("v", VENUES)
VX = ("vx", f"SELECT *, {_VX} AS x, {_VY} AS y FROM v")
AX = ("ax", f"SELECT anchor_id, {_VX} AS x, {_VY} AS y FROM ({ANCHORS})")
AR = ("areas", AREAS)
DEDUP = ("d", "SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY review_count DESC NULLS LAST, venue_id) = 1")
BBOX = ("b", "SELECT * FROM v WHERE latitude BETWEEN 1.15::DOUBLE AND 1.48::DOUBLE AND longitude BETWEEN 103.6::DOUBLE AND 104.05::DOUBLE")
TOPCAT = ("topcat", f"SELECT category FROM v WHERE category IS NOT NULL GROUP BY category ORDER BY count(*) DESC, category LIMIT {K.TOP_CATEGORIES}")
VCE = ("vce", "SELECT v.*, CASE WHEN t.category IS NOT NULL THEN v.category ELSE 'Other' END AS category_encoded FROM v LEFT JOIN topcat t ON v.category = t.category")
DENS = ("dens", """SELECT a.venue_id, CAST(count(*) - 1 AS BIGINT) AS cluster_density
FROM vx a JOIN vx b ON b.x BETWEEN a.x - 200.0 AND a.x + 200.0 AND b.y BETWEEN a.y - 200.0 AND a.y + 200.0
 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 200.0
GROUP BY a.venue_id""")
WITHIN = ("within", """SELECT v.venue_id, arg_min(a.area, a.area_ord) AS area_within
FROM v LEFT JOIN areas a ON a.x0 < v.longitude AND v.longitude < a.x1 AND a.y0 < v.latitude AND v.latitude < a.y1
GROUP BY v.venue_id""")


def _edges_sql() -> str:
    parts = []
    for (ax, ay, bx, by) in [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"),
                             ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")]:
        x1, y1 = tm_sql(ax, ay)
        x2, y2 = tm_sql(bx, by)
        parts.append(f"SELECT area, area_ord, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM areas")
    return "\nUNION ALL\n".join(parts)


EDGES_M = ("em", _edges_sql())
_SEG = """sqrt((mx - (x1 + t * dx)) * (mx - (x1 + t * dx)) + (my - (y1 + t * dy)) * (my - (y1 + t * dy)))"""
NEAR = ("near", f"""SELECT venue_id, area AS near_area FROM (
  SELECT venue_id, area, row_number() OVER (PARTITION BY venue_id ORDER BY dist, area_ord) AS rk FROM (
    SELECT venue_id, area, area_ord, radius, {_SEG} AS dist FROM (
      SELECT u.venue_id, u.mx, u.my, u.radius, e.area, e.area_ord, e.x1, e.y1, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy,
        least(greatest(CASE WHEN (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1) > 0
             THEN ((u.mx - e.x1) * (e.x2 - e.x1) + (u.my - e.y1) * (e.y2 - e.y1))
                  / ((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)) ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE) AS t
      FROM (SELECT v.venue_id, {_VX} AS mx, {_VY} AS my,
                   CASE WHEN latitude > 1.44::DOUBLE THEN 100.0::DOUBLE ELSE 2000.0::DOUBLE END AS radius
            FROM v JOIN within w ON v.venue_id = w.venue_id WHERE w.area_within IS NULL) u, em e)
  ) WHERE dist <= radius
) WHERE rk = 1""")
ASSIGN = ("assigned", """SELECT v.venue_id,
  CASE WHEN v.latitude > 1.47::DOUBLE THEN 'Outside Singapore'
       ELSE coalesce(w.area_within, n.near_area, 'Outside Singapore') END AS planning_area
FROM v JOIN within w ON v.venue_id = w.venue_id LEFT JOIN near n ON v.venue_id = n.venue_id""")
AREA_CTES = (V, AR, WITHIN, EDGES_M, NEAR, ASSIGN)

# context model (M7) over (category, price_level) on the cleaned table
M7_KEYS = ("category", "price_level")


def m7(src: str, keys=M7_KEYS, lam: float = 1.0) -> tuple[str, str]:
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    ks = ", ".join(keys)
    gmean = (f"(SELECT CAST(sum(CAST(rating AS DECIMAL(38,10))) AS DOUBLE) / CAST(count(*) AS DOUBLE) "
             f"FROM {src} WHERE rating IS NOT NULL)")
    return ("m7", f"""SELECT s.*, p AS predicted_rating, s.rating - p AS residual FROM (
  SELECT s.*, (coalesce(g.gs, 0.0) + {lam!r}::DOUBLE * {gmean})
              / (coalesce(g.gn, 0) + {lam!r}::DOUBLE) AS p
  FROM {src} s LEFT JOIN (SELECT {ks}, CAST(sum(CAST(rating AS DECIMAL(38,10))) AS DOUBLE) AS gs, count(*) AS gn
                          FROM {src} WHERE rating IS NOT NULL GROUP BY {ks}) g
  ON {on}) s""")


CLEAN = (V, BBOX, ("d", "SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY name ORDER BY review_count DESC NULLS LAST, venue_id) = 1"))


def fixed_sql(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def explanation_sql(rating="rating", r="residual", pred="predicted_rating", reviews="review_count",
                    dens="cluster_density", area="planning_area", cuisine="category") -> str:
    rv = f"coalesce(CAST({reviews} AS BIGINT), 0)"
    dn = f"coalesce(CAST({dens} AS BIGINT), 0)"
    fac = (f"concat_ws(', ', CASE WHEN {cuisine} IS NOT NULL AND {cuisine} <> '' AND {cuisine} <> 'Other' THEN concat({cuisine}, ' cuisine') END, "
           f"CASE WHEN {rv} < 20 THEN 'very few reviews' WHEN {rv} < 100 THEN concat(CAST({rv} AS VARCHAR), ' reviews') "
           f"WHEN {rv} > 500 THEN concat('high popularity (', CAST({rv} AS VARCHAR), ' reviews)') END, "
           f"CASE WHEN {dn} < 5 THEN 'low competition nearby' WHEN {dn} > 40 THEN 'highly competitive area' END)")
    f = f"(CASE WHEN {fac} = '' THEN 'its profile' ELSE {fac} END)"
    a = f"coalesce({area}, 'this area')"
    p1 = fixed_sql(f"coalesce({pred}, {rating} - {r})", 1)
    a1 = fixed_sql(rating, 1)
    t = [tpl.replace("'", "''") for tpl in K.EXPLANATION_TEMPLATES]

    def fill(tpl):
        out = []
        import re
        for tok in re.split(r"(\{\w+\})", tpl):
            if tok == "{f}":
                out.append(f)
            elif tok == "{area}":
                out.append(a)
            elif tok == "{pred}":
                out.append(p1)
            elif tok == "{act}":
                out.append(a1)
            elif tok:
                out.append(f"'{tok}'")
        return "concat(" + ", ".join(out) + ")"
    return (f"CASE WHEN {r} >= 0.5::DOUBLE THEN {fill(t[0])} WHEN {r} > 0.1::DOUBLE THEN {fill(t[1])} "
            f"WHEN {r} > -0.1::DOUBLE THEN {fill(t[2])} WHEN {r} > -0.5::DOUBLE THEN {fill(t[3])} ELSE {fill(t[4])} END")


def colour_sql(r: str, values: list[str]) -> str:
    return (f"CASE WHEN {r} >= 0.5::DOUBLE THEN {values[0]} WHEN {r} > 0.0::DOUBLE THEN {values[1]} "
            f"WHEN {r} > -0.5::DOUBLE THEN {values[2]} ELSE {values[3]} END")


def keyword_sql(text: str, lexicon: dict[str, list[str]], other: str = K.OTHER) -> str:
    scores = []
    for i, (label, words) in enumerate(lexicon.items()):
        s = " + ".join(f"CASE WHEN contains(lower({text}), {lit(w)}) THEN {len(w)} ELSE 0 END" for w in words)
        scores.append((label, i, f"coalesce({s}, 0)"))
    best = "greatest(" + ", ".join(f"struct_pack(s := {s}, o := {-i}, l := {lit(label)})"
                                    for label, i, s in scores) + ")"
    return f"(CASE WHEN ({best}).s > 0 THEN ({best}).l ELSE {lit(other)} END)"

"""Scalar column functions (all built-in expressions, inside whole-stage codegen).

Numbers rendered as text use ``fixed_decimal``: the exact binary value rounded
to nearest, exact ties to even, with a sign for every negative value (so -0.001
gives ``-0.00`` and 0.125 gives ``0.12``, as C's ``%.2f`` does), in built-in
double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN compares TRUE against thresholds in Spark; treat it as missing."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def fixed_decimal(c, digits: int) -> Column:
    """Fixed-point text of a double as ``%.<digits>f`` writes it: 4.256 → '4.26' (digits ≥ 1).

    ``scaled`` is the product with 10^digits rounded once; where it falls on a half,
    ``low``, the exact error of that product (the value split into two halves of 26
    bits), says on which side the true value lies.
    """
    scale = 10 ** digits
    x = col(c)
    a = F.abs(x)
    scaled = a * float(scale)
    split = a * 134217729.0  # 2^27 + 1
    high = split - (split - a)
    low = (high * float(scale) - scaled) + (a - high) * float(scale)
    whole = F.floor(scaled).cast("bigint")
    over = scaled - whole
    up = (over > 0.5) | ((over == 0.5) & ((low > 0.0) | ((low == 0.0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    frac = F.lpad((n % scale).cast("string"), digits, "0")
    return F.when(n.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                 F.floor(n / scale).cast("bigint").cast("string"), F.lit("."), frac))


# --- features ---------------------------------------------------------------

def log_reviews(review_count="review_count") -> Column:
    return F.log1p(F.coalesce(col(review_count).cast("double"), F.lit(0.0)))


def price_level_num(price_level="price_level", levels: dict = K.PRICE_LEVELS,
                    default: float = K.PRICE_DEFAULT) -> Column:
    e = None
    for sym, v in levels.items():
        cond = col(price_level) == F.lit(sym)
        e = F.when(cond, F.lit(float(v))) if e is None else e.when(cond, F.lit(float(v)))
    return e.otherwise(F.lit(float(default)))


def url_coords(url="url") -> tuple[Column, Column]:
    """(lat, lon) from ``!3d<lat>`` and ``!4d<lon>``; both or neither; bad numbers → NULL."""
    lat_s = F.regexp_extract(col(url), r"!3d([\d.]+)", 1)
    lon_s = F.regexp_extract(col(url), r"!4d([\d.]+)", 1)
    ok = (lat_s != "") & (lon_s != "")
    lat = F.when(ok, lat_s.try_cast("double"))
    lon = F.when(ok, lon_s.try_cast("double"))
    both = lat.isNotNull() & lon.isNotNull()
    return F.when(both, lat), F.when(both, lon)


def coord_overrides(df: DataFrame, rules=K.COORD_OVERRIDES, name: str = "name",
                    lat: str = "latitude", lon: str = "longitude",
                    mode: str = "contains") -> DataFrame:
    """Replace lat/lon of rows whose name matches a rule; later rules win.

    ``mode="contains"`` is the case-insensitive substring test of the original;
    ``mode="word"`` requires word boundaries around the pattern.
    """
    lname = F.lower(col(name))
    new_lat, new_lon = col(lat), col(lon)
    for pattern, plat, plon in rules:        # later rules are applied last → win
        p = pattern.lower()
        if mode == "word":
            hit = lname.rlike(r"(^|\W)" + _re_escape(p) + r"($|\W)")
        else:
            hit = lname.contains(p)
        hit = F.coalesce(hit, F.lit(False))
        new_lat = F.when(hit, F.lit(float(plat))).otherwise(new_lat)
        new_lon = F.when(hit, F.lit(float(plon))).otherwise(new_lon)
    return df.withColumns({lat: new_lat, lon: new_lon})


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


# --- residual classes ---------------------------------------------------------

def residual(rating="rating", predicted="predicted_rating") -> Column:
    return col(rating) - col(predicted)


def _four_way(r, values):
    r = col(r)
    return (F.when(r >= K.GEM_THRESHOLD, values[0])
            .when(r > 0.0, values[1])
            .when(r > -K.GEM_THRESHOLD, values[2])
            .otherwise(values[3]))


def colour_rgba(r="residual") -> Column:
    return _four_way(r, [F.array(*[F.lit(v) for v in rgba]) for rgba in K.COLOUR_RGBA])


def colour_hex(r="residual") -> Column:
    return _four_way(r, [F.lit(h) for h in K.COLOUR_HEX])


def value_label(r="residual") -> Column:
    r = col(r)
    return (F.when(r >= K.GEM_THRESHOLD, F.lit(K.VALUE_LABELS[0]))
            .when(r >= 0.0, F.lit(K.VALUE_LABELS[1]))
            .when(r < 0.0, F.lit(K.VALUE_LABELS[2])))


def badge(r="residual") -> Column:
    r = col(r)
    txt = fixed_decimal(r, 2)
    return F.when(r >= 0.0, F.concat(F.lit("Underrated +"), txt)) \
            .when(r < 0.0, F.concat(F.lit("Overrated "), txt))


def gap_text(r="residual") -> Column:
    r = col(r)
    txt = fixed_decimal(r, 2)
    return F.when(r > 0.0, F.concat(F.lit("+"), txt)).otherwise(txt)


def search_url(name="name", prefix: str = K.SEARCH_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.replace(col(name), F.lit(" "), F.lit("+")))


def area_text(area="planning_area") -> Column:
    return F.coalesce(col(area), F.lit(K.UNKNOWN_AREA))


def explanation(rating="rating", residual_col="residual", predicted="predicted_rating",
                review_count="review_count", density="cluster_density",
                area="planning_area", cuisine="category") -> Column:
    """One sentence per row explaining the gap (built-in string functions only)."""
    r = col(residual_col)
    pred = F.coalesce(col(predicted), col(rating) - r) if predicted else col(rating) - r
    reviews = F.coalesce(col(review_count).cast("bigint"), F.lit(0))
    dens = F.coalesce(col(density).cast("bigint"), F.lit(0)) if density else F.lit(0)
    cz = col(cuisine) if cuisine else F.lit(None).cast("string")
    factors = F.concat_ws(
        ", ",
        F.when(cz.isNotNull() & (cz != "") & (cz != K.OTHER), F.concat(cz, F.lit(" cuisine"))),
        F.when(reviews < K.FEW_REVIEWS, F.lit(K.FACTOR_FEW_REVIEWS))
         .when(reviews < K.SOME_REVIEWS, F.concat(reviews.cast("string"), F.lit(" reviews")))
         .when(reviews > K.POPULAR_REVIEWS,
               F.concat(F.lit("high popularity ("), reviews.cast("string"), F.lit(" reviews)"))),
        F.when(dens < K.LOW_DENSITY, F.lit(K.FACTOR_LOW_DENSITY))
         .when(dens > K.HIGH_DENSITY, F.lit(K.FACTOR_HIGH_DENSITY)),
    )
    f = F.when(factors == "", F.lit(K.FACTOR_NO_FACTORS)).otherwise(factors)
    a = F.coalesce(col(area), F.lit(K.AREA_FALLBACK)) if area else F.lit(K.AREA_FALLBACK)
    p1, a1 = fixed_decimal(pred, 1), fixed_decimal(col(rating), 1)
    t = [_fill(tpl, f=f, area=a, pred=p1, act=a1) for tpl in K.EXPLANATION_TEMPLATES]
    g, up, flat, down = K.SENTENCE_THRESHOLDS
    return (F.when(r >= g, t[0]).when(r > up, t[1]).when(r > flat, t[2])
            .when(r > down, t[3]).otherwise(t[4]))


def _fill(template: str, **parts: Column) -> Column:
    """Template with ``{name}`` slots → concat of literals and columns."""
    import re
    pieces = []
    for tok in re.split(r"(\{\w+\})", template):
        if tok.startswith("{") and tok.endswith("}"):
            pieces.append(parts[tok[1:-1]])
        elif tok:
            pieces.append(F.lit(tok))
    return F.concat(*pieces)

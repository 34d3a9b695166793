"""Fixed values.

Everything in this module must equal the original pipeline's values for the
results to agree: thresholds, colours, labels, text templates, the coordinate
override rules and the projection parameters. They are stated here once, in
their natural order, and passed as defaults everywhere else (every function
takes them as parameters so the engine works for any city).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — spatial thresholds (metres / degrees)
# ---------------------------------------------------------------------------
ANCHOR_FLAG_M = 50.0            # is_hawker: strictly closer than this
DENSITY_RADIUS_M = 200.0        # cluster_density: neighbours within (inclusive)
BORDER_RADIUS_M = 100.0         # nearest-area search radius north of BORDER_LAT
MAINLAND_RADIUS_M = 2000.0      # nearest-area search radius elsewhere
BORDER_LAT = 1.44               # strict ">" selects the border radius
HARD_CUTOFF_LAT = 1.47          # strict ">" forces OUTSIDE_AREA
NO_ANCHOR_DIST = 9999.0         # distance when there are no anchors
OUTSIDE_AREA = "Outside Singapore"
UNKNOWN_AREA = "Unknown"
DEFAULT_CENTRE = (1.3521, 103.8198)   # (lat, lon)
ZOOM_ALL, ZOOM_AREA = 11, 13

# bounding boxes: (lat_min, lat_max, lon_min, lon_max)
BBOX_INCLUSIVE = (1.15, 1.48, 103.6, 104.05)
LAT_BAND_STRICT = (1.15, 1.48)

# ---------------------------------------------------------------------------
# FIXED VALUES — feature rules
# ---------------------------------------------------------------------------
DEFAULT_DENSITY = 10            # neighbours of a row in a table without that column
CHAIN_MIN_COUNT = 2             # is_chain: count(name) > 2
TOP_CATEGORIES = 20             # categories kept before bucketing to OTHER
OTHER = "Other"
PRICE_LEVELS = {"$": 1, "$$": 2, "$$$": 3, "$$$$": 4}
PRICE_DEFAULT = 1.0

# coordinate override rules, in order (later rules win):
# (case-insensitive substring of the name, latitude, longitude)
COORD_OVERRIDES = [
    ("Luss Restaurant", 1.2915, 103.7925),
    ("9 Plus Bistro", 1.2830, 103.7810),
    ("Wu You Eating Place", 1.3130, 103.8610),
    ("Oasis Hideout", 1.3050, 103.7800),
    ("L Bistro", 1.3330, 103.7430),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — residual classes and display
# ---------------------------------------------------------------------------
GEM_THRESHOLD = 0.5
# colour classes: residual >= 0.5, > 0, > -0.5, otherwise
COLOUR_RGBA = [
    [42, 157, 143, 200],
    [233, 196, 106, 200],
    [244, 162, 97, 200],
    [231, 111, 81, 200],
]
COLOUR_HEX = ["#2a9d8f", "#e9c46a", "#f4a261", "#e76f51"]
VALUE_LABELS = ["Hidden Gem", "Fair Value", "Overvalued"]
BADGE_POSITIVE = "Underrated +%s"
BADGE_NEGATIVE = "Overrated %s"
SEARCH_URL_PREFIX = "https://www.google.com/maps/search/?api=1&query="

# explanation: review-count bands, density bands, sentence thresholds
FEW_REVIEWS, SOME_REVIEWS, POPULAR_REVIEWS = 20, 100, 500
LOW_DENSITY, HIGH_DENSITY = 5, 40
SENTENCE_THRESHOLDS = (0.5, 0.1, -0.1, -0.5)
EXPLANATION_TEMPLATES = [
    "With {f}, similar spots in {area} average {pred}★. This place beats expectations at {act}★ - a true gem!",
    "Based on {f}, we'd expect {pred}★. Scoring {act}★ means it's performing above average.",
    "Rating of {act}★ is in line with expectations ({pred}★) for {f}. No surprises here.",
    "Given {f}, similar places score {pred}★. At {act}★, this is slightly below expectations.",
    "With {f}, we'd expect {pred}★. The {act}★ rating suggests it's underperforming.",
]
FACTOR_NO_FACTORS = "its profile"
FACTOR_CUISINE = "{} cuisine"
FACTOR_FEW_REVIEWS = "very few reviews"
FACTOR_SOME_REVIEWS = "{} reviews"
FACTOR_POPULAR = "high popularity ({} reviews)"
FACTOR_LOW_DENSITY = "low competition nearby"
FACTOR_HIGH_DENSITY = "highly competitive area"
AREA_FALLBACK = "this area"
ALL_AREAS, ALL_CUISINES = "All Areas", "All Cuisines"
DEFAULT_MIN_RATING, DEFAULT_MIN_REVIEWS = 3.5, 5

# ---------------------------------------------------------------------------
# FIXED VALUES — external classifier
# ---------------------------------------------------------------------------
CUISINE_LABELS = [
    "Japanese", "Korean", "Chinese", "Indian", "Thai", "Vietnamese",
    "Malay", "Western", "Italian", "Mexican", "Middle Eastern",
    "Seafood", "Hawker", "Cafe", "Fast Food", "BBQ", "Other",
]
BATCH_SIZE = 20
PROMPT_TEMPLATE = """You are a cuisine classifier for Singapore restaurants. 
Classify each restaurant into ONE of these categories:
{categories}

Rules:
- Respond with ONLY the restaurant name and category, one per line, format: "Name | Category"
- If you cannot determine the cuisine, use "Other"
- "Western" includes American, British, European, fusion restaurants
- "Hawker" is for food courts, hawker centers, eating houses
- "Cafe" is for coffee shops, bakeries, dessert places

Restaurant names:
{names}

Classifications:"""
MATCH_PREFIX_CHARS = 20

# ---------------------------------------------------------------------------
# FIXED VALUES — model
# ---------------------------------------------------------------------------
CV_FOLDS = 5
PERM_REPEATS = 10
SEED = 42
SAMPLE_N = 50
TOP_K_SERVE, TOP_K_TRAIN, TOP_K_RETRAIN = 20, 5, 10

# ---------------------------------------------------------------------------
# FIXED VALUES — projections (WGS84 ellipsoid; local Transverse Mercator grid)
# ---------------------------------------------------------------------------
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
LOCAL_TM = {
    "lat0": 1.0 + 22.0 / 60.0,       # 1°22′N
    "lon0": 103.0 + 50.0 / 60.0,     # 103°50′E
    "k0": 1.0,
    "false_easting": 28001.642,
    "false_northing": 38744.572,
}
WEB_MERCATOR_R = 6378137.0

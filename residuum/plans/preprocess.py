"""Feature build (the original preprocessing stage) as one Spark plan.

Order of operations follows the original with two documented choices:
frequency and density features are computed on the rows as given (``refresh`` says
whether before or after dedup: after it every name is a non-chain);
``overrides_first`` applies coordinate overrides before the
distance features (the original applies them after, so overridden rows keep
distances of their wrong location — pass ``overrides_first=False`` for that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.functions.geo import project_local_m
from residuum.operators import spatial as S
from residuum.operators.features import add_features, is_chain, top_category_bucket
from residuum.sources.schema import require_columns


def preprocess(df: DataFrame, anchors: DataFrame | None, edges: DataFrame | None,
               overrides=K.COORD_OVERRIDES, overrides_first: bool = True) -> DataFrame:
    """venues → + log_reviews, is_chain, dist_to_hawker, is_hawker, category_encoded,
    cluster_density, price_level_num, planning_area.

    The coordinate features are computed together on distinct coordinates and
    joined back once (``spatial_features``); with ``overrides_first=False``
    they use two coordinate sets, so they are chained instead.
    """
    require_columns(df, "longitude", "latitude")
    out = add_features(df)
    out = is_chain(out)
    out = top_category_bucket(out)
    use_overrides = edges is not None and overrides
    if use_overrides and overrides_first:
        out = C.coord_overrides(out, overrides)
    if not (use_overrides and not overrides_first):
        # all coordinate features from one pass over the distinct coordinates
        return S.spatial_features(out, anchors, edges)
    # original order: distances on the scraped point, areas on the corrected one
    out = project_local_m(out)
    a = project_local_m(anchors) if anchors is not None else None
    out = S.cluster_density(S.nearest_anchor(out, a))
    out = C.coord_overrides(out, overrides)
    return S.assign_area(out, edges).drop("x", "y")

"""Column expressions: missing values, seeded order, power transforms, projections, display."""

from pixelloom.functions.display import colour_index, to_3857, web_tile
from pixelloom.functions.missing import finite, is_sentinel, normalise_missing
from pixelloom.functions.power import (
    clip_inverse_domain,
    inverse_yeo_johnson,
    yeo_johnson,
    yeo_johnson_core,
)
from pixelloom.functions.projection import from_6933, to_6933
from pixelloom.functions.seeded import seeded_key
from pixelloom.functions.vectors import centre_slice, dot, finite_share, sanitise_vector

__all__ = [
    "centre_slice", "clip_inverse_domain", "colour_index", "dot", "finite", "finite_share",
    "from_6933", "inverse_yeo_johnson", "is_sentinel", "normalise_missing", "sanitise_vector",
    "seeded_key", "to_3857", "to_6933", "web_tile", "yeo_johnson", "yeo_johnson_core",
]

from .text import (  # noqa: F401
    compose_text,
    cosine,
    normalize_unit,
    slugify,
    stable_listing_id,
    token_jaccard,
    tokens,
    truthy,
    truthy_num,
)
from .register import register_functions  # noqa: F401
from .scorers import batch_scorer, hashed_counts, text_features, weight_vector  # noqa: F401

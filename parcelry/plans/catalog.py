"""All registered queries."""

from __future__ import annotations

from parcelry.plans import listing_queries, model_queries, text_queries

CATALOG = {
    **listing_queries.registry.entries,
    **text_queries.registry.entries,
    **model_queries.registry.entries,
}

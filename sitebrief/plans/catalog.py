"""Imports every plan module, so that the registry is full."""

from sitebrief.plans import (  # noqa: F401
    aggregate_plans,
    dedup_plans,
    extract_plans,
    join_plans,
    list_plans,
    page_plans,
    rank_plans,
    scalar_plans,
    set_plans,
    sink_plans,
    site_plans,
    stream_plans,
    url_plans,
)
from sitebrief.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Job names of the streaming catalogue and the queries that answer to them."""

from __future__ import annotations

from collections.abc import Callable

from . import catalog

# The job names that users deploy by.
JOBS = {
    "nexmark_query1": "q1_currency",
    "nexmark_query2": "q2_selection",
    "nexmark_query3": "q3_deployed",
    "nexmark_query3_warmup": "q3_deployed_warm",
    "nexmark_query4": "q4_category_average",
    "nexmark_query4_modified": "q4_mod",
    "nexmark_query5": "q5_hot_items",
    "nexmark_query6": "q6_seller_average",
    "nexmark_query6_modified": "q6_mod",
    "nexmark_query7": "q7_highest_bid",
    "nexmark_query8": "q8_new_users",
    "taxi": "taxi_route_median",
    "taxi_warmup": "taxi_route_median_warm",
    "twitch": "twitch_trend",
    "borg": "borg_busy_machine",
    "borg_warmup": "borg_busy_machine_warm",
    "azure": "azure_cpu_readings",
    "azure_warmup": "azure_cpu_readings_warm",
}
DEFAULT = "counter"


def query(name: str | None = None) -> Callable:
    """The query of a job or catalogue name; the default job without one."""
    name = JOBS.get(name or DEFAULT, name or DEFAULT)
    if name not in catalog.QUERIES:
        raise KeyError(f"no query is named {name}; there are {sorted([*JOBS, *catalog.QUERIES])}")
    return catalog.QUERIES[name]

"""All bound queries. Importing this module registers every ``bind_*`` module."""

from wirefold.plans import (bind_candidates, bind_graph, bind_lifecycle, bind_names, bind_resolve,  # noqa: F401
                            bind_routes, bind_routes2, bind_tx_roles)
from wirefold.plans import bind_condensed, bind_coverage, bind_gold, bind_incremental, bind_ordered, bind_role_bitmaps, bind_scoped, bind_storage, bind_streaming, bind_trees  # noqa: F401,E402  (compose the modules above)
from wirefold.plans.registry import ORACLE, QUERIES  # noqa: F401,E402

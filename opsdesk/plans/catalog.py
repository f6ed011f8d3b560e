"""Import every catalogue module so its queries register, and expose the registry."""

from __future__ import annotations

from opsdesk.plans import catalog_ops  # noqa: F401  (registers queries)
from opsdesk.plans.registry import REGISTRY, Query

_OPTIONAL = ["opsdesk.plans.catalog_text", "opsdesk.plans.catalog_flow",
             "opsdesk.plans.catalog_io", "opsdesk.plans.catalog_stream"]

for _mod in _OPTIONAL:
    try:
        __import__(_mod)
    except ModuleNotFoundError as exc:  # module not written yet
        if exc.name != _mod:
            raise

FLAGSHIP = "sla_health_by_category"


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)

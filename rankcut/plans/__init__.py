"""The registered queries: each applies operators of the library to whole tables, with its SQL beside it."""

from rankcut.plans import catalog as _catalog  # noqa: F401
from rankcut.plans import passages as _passages  # noqa: F401
from rankcut.plans import retrieval as _retrieval  # noqa: F401
from rankcut.plans import sources as _sources  # noqa: F401
from rankcut.plans import text as _text  # noqa: F401
from rankcut.plans import validation as _validation  # noqa: F401
from rankcut.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

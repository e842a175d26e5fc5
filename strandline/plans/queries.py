"""All registered queries: over the driver tables (``catalogue``, ``mechanisms``) and over scenarios planted into them (``fixtures``)."""

from strandline.plans import fixtures, mechanisms  # noqa: F401  register their queries
from strandline.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

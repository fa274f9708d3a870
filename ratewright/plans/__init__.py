"""Queries by section; importing this package registers them all."""

from . import catalog, matching, rates, relational, scalars, stored

FLAGSHIP = relational._a05

__all__ = ["FLAGSHIP", "catalog", "matching", "rates", "relational", "scalars", "stored"]

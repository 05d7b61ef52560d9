"""Bindings of the operators to the driver's tables, each beside an independent SQL statement of the same result."""

from . import files, frames, index, live, retrieve, training  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES  # noqa: F401

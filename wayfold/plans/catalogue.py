"""All queries of the engine (its training-data queries apart)."""

from . import details, extras, fields, joins, reports, windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

"""All queries of the library over the test tables, and the SQL that must give the same rows."""

from . import further, more, records, statistics, texts  # noqa: F401  each registers its queries
from .base import ORACLE, QUERIES  # noqa: F401

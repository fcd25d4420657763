"""Registered queries: each a Spark plan over the given tables, most with a SQL twin."""

from catalog import corpus, features, fitted, flows, scalars, tables_io  # noqa: F401
from catalog.registry import QUERIES, SQL  # noqa: F401

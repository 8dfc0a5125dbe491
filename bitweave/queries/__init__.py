"""Registered queries of the core. Importing the modules fills the catalog."""

from bitweave.queries import algebra, analysis, engine, extras, graph, models, reasoning, stores, texts  # noqa: F401
from bitweave.queries import harness  # noqa: F401  (after those it restates)

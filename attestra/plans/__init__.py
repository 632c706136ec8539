"""Plans: the registered queries."""

from . import catalogue, content, evidence, stores  # noqa: F401  (the latter three add their queries to the catalogue)

"""Importing this module registers every query."""

from leafmill.plans import catalogs, changes, documents, enrichment, evaluation, files, flows  # noqa: F401

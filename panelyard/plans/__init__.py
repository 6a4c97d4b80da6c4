"""Queries over the given tables; importing the package registers all of them in the catalog."""

from . import accounts, catalog, models, records, signals, streams, study

"""Registered queries and their checking SQL."""

from . import addresses, runtime, stores, tables, texts

QUERIES: dict = texts.QUERIES | tables.QUERIES | addresses.QUERIES | runtime.QUERIES | stores.QUERIES
ORACLES: dict = texts.ORACLES | tables.ORACLES | addresses.ORACLES | runtime.ORACLES | stores.ORACLES

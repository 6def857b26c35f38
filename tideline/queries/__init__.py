"""Registered queries and their SQL."""

from tideline.queries import core, models, streams, tables

QUERIES = {**core.QUERIES, **tables.QUERIES, **models.QUERIES, **streams.QUERIES}
ORACLES = {**core.ORACLES, **tables.ORACLES, **models.ORACLES, **streams.ORACLES}

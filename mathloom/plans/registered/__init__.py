"""Queries over the driver's tables, one per operator, each with its SQL counterpart.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame`` and ``ORACLES`` to the SQL.
"""

from . import curation, files, latex, layouts, structure, text

_MODULES = (files, curation, text, latex, structure, layouts)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

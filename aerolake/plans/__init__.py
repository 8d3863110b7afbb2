"""The registered queries over the driver's tables, and their SQL."""

from . import advisories, datasets, formulas, tables  # noqa: F401

FLAGSHIP = "navaid_nearest"
QUERIES = formulas.QUERIES | tables.QUERIES
ORACLE_SQL = formulas.ORACLE_SQL | tables.ORACLE_SQL

"""Named analyses over the test tables, each paired with an independent SQL oracle."""

from claimlens.plans.catalog import CATALOG, oracle_sql, queries  # noqa: F401

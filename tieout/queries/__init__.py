"""Every operator as a query over the given tables, with SQL for the same result where SQL can say it."""

from tieout.queries.registry import ORACLES, QUERIES
from tieout.queries import columns, deliveries, formulas, frames, functions, handed, reports, structure, tieouts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]

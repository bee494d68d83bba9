"""Named queries with their DuckDB SQL; importing this package fills the registry."""

from . import batches, formats, graphs, relational, schemas, timeseries  # noqa: F401
from ..plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

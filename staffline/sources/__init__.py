"""Where the four HR tables come from: catalog tables, parquet folders, or
the test fixture views derived from the driver tables."""

from .fixtures import AS_OF, fixture_tables
from .tables import catalog_tables, parquet_tables, qualified_name

__all__ = ["AS_OF", "fixture_tables", "catalog_tables", "parquet_tables", "qualified_name"]

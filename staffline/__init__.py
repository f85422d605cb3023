"""staffline: workforce reports on Spark DataFrames.

Every report takes ``tables`` (a dict of DataFrames keyed by
``employees``, ``employee_benefits``, ``leave_requests`` and
``performance_reviews``) and returns a lazy DataFrame.
"""

from . import functions, operators, schemas, sources
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _ops_all

__all__ = ["functions", "operators", "schemas", "sources", *_ops_all]

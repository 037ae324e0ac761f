"""Names of the queries and their DuckDB counterparts."""

from . import campaign as _campaign  # noqa: F401 - registers its queries
from . import programs as _programs  # noqa: F401 - registers its queries
from . import sequences as _sequences  # noqa: F401 - registers its queries
from .queries import ORACLES, QUERIES

FLAGSHIP = "fastp_report"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

"""All registered queries."""

from shiftframe.plans import (  # noqa: F401
    queries_consensus,
    queries_records,
    queries_structure,
    queries_signals,
    queries_files,
    queries_pipelines,
)
from shiftframe.plans.registry import ORACLE, QUERIES  # noqa: F401

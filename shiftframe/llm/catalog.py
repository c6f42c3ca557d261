"""All registered queries of this subpackage."""

from shiftframe.llm import queries_models, queries_native

QUERIES = queries_native.QUERIES | queries_models.QUERIES
ORACLE = queries_native.ORACLE | queries_models.ORACLE

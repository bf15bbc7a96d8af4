"""All registered queries: importing the parts fills the registry."""

from . import queries_cohort, queries_de, queries_flows, queries_matrix, queries_ml, queries_tests  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

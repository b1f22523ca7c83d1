"""Registered queries. Importing the package registers all of them."""

from crowdgauge.plans import (  # noqa: F401
    estimation,
    models,
    people,
    publishing,
    questions,
    replicates,
    reporting,
    sampling,
    selection,
    streams,
)
from crowdgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

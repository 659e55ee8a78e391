"""Imports every query module, so that the catalog is complete."""

from goldweave.plans import (  # noqa: F401
    cleansing_queries,
    golden_queries,
    matching_queries,
    profiling_queries,
    reporting_queries,
    review_queries,
    storage_queries,
    survivorship_queries,
)
from goldweave.plans.catalog import CATALOG  # noqa: F401

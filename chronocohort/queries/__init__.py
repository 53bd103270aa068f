"""Registered queries over the test tables, one per operator."""

from chronocohort.queries import (  # noqa: F401
    aggregates_q,
    features_q,
    flows_q,
    icu_q,
    icu_variants_q,
    io_q,
    joins_q,
    reshape_q,
    sampling_q,
    scalars_q,
    windows_q,
)
from chronocohort.queries.registry import ORACLES, QUERIES  # noqa: F401

"""Registered queries.  Importing the package fills the registry."""

from . import (  # noqa: F401
    aggregate_queries,
    fold_queries,
    geo_queries,
    join_queries,
    model_oracle_queries,
    model_queries,
    plan_queries,
    scalar_queries,
    selection_queries,
    source_queries,
    station_queries,
    stream_queries,
)
from .base import REGISTRY, registered_oracles, registered_queries  # noqa: F401

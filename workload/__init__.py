"""Queries over the driver tables, one per operator, each with its SQL where SQL can say it."""

from workload import boosting, columns, features, models, query_verbs, sources, splits, stores, streams  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401

"""Queries over the driver tables, each with its SQL counterpart where plain SQL can say it."""

from . import (  # noqa: F401
    aggregates, evaluation, extraction, joins, projections, recommending, scoring, sources_sinks, streams, texts,
)
from .base import REGISTRY

"""Registered queries: every operator bound to the driver tables, with its SQL check."""

from . import (  # noqa: F401
    alignment,
    answers,
    datasets,
    detection,
    documents,
    extraction,
    features,
    labels,
    pixels,
    places,
    plans,
    reporting,
    statistics,
    streams,
    temporal,
    verdicts,
)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

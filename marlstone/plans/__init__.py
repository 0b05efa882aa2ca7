"""Registered queries over the driver's tables."""

from marlstone.plans import closed, files, records, runs, scoring, taxonomy
from marlstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "closed", "files", "records", "runs", "scoring", "taxonomy"]

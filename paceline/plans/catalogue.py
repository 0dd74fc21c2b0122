"""Every registered query, by importing the modules that register them."""

from paceline.plans import choosing, collecting, extraction, filing, measuring, reporting  # noqa: F401
from paceline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

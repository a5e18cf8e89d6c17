"""Imports every query module so they register themselves."""

from pluvio.plans import q_blocks, q_draws, q_gev, q_relational, q_spatial, q_stream  # noqa: F401
from pluvio.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

"""Predicate-skipping analytics on Spark: managed tables whose recurring filters skip blocks known to hold no match."""

from .engine import Engine
from .geometry import Geometry

__all__ = ["Engine", "Geometry"]

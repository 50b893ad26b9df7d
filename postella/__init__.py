"""Search and analytics over large sparse group-labelled matrices, as plans over Spark tables."""

from .plans.atlas import Atlas, build, merge
from .sources.tables import load, save

__all__ = ["Atlas", "build", "load", "merge", "save"]

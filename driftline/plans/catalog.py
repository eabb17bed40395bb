"""Importing this module registers every query."""

from . import blobs, boards, rasters, relations, scalars, stores, trajectories, views  # noqa: F401

"""Queries over the driver's tables; importing this package registers them."""

from . import accuracy, areas, layers, models, rasters, records, seasons, shapes, small, streams, terrain  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

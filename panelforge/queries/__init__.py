"""Registered queries and their SQL twins."""

from . import files, models, panels, profiles, records  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

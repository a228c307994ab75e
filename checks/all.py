"""Importing this module registers every query."""

from checks import columns, loads, reports, searches  # noqa: F401

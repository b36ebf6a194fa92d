"""Canonical schema, loader and the test-table adapter."""

from .tables import Marketplace, load, write_canonical  # noqa: F401

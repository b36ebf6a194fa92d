"""Micro-batch data-quality monitoring of arriving order files."""

from .monitor import order_checks, start_order_quality_monitor  # noqa: F401

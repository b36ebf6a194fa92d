"""Column helpers (``columns``)."""

"""The analytics (caterer, revenue, retention, promo, experiment, ltv), the
data-quality checks (quality) and the distributed ranking helpers (ranking)."""

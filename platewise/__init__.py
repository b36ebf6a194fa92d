"""platewise: batch analytics for a two-sided B2B catering marketplace on Spark.

Every operator takes and returns Spark DataFrames and is written with built-in
Column functions, aggregations, joins and windows so that Catalyst plans the
work.  Layout:

* ``sources``   canonical schemas, the loader and the test-table adapter
* ``functions`` Column helpers (exact rounding, day/month arithmetic, ordinals)
* ``operators`` the analytics (caterer, revenue, retention, promo, experiment,
                ltv), data-quality checks and the distributed ranking helpers
* ``plans``     the query registry, its DuckDB oracle SQL and plan checks
* ``streaming`` micro-batch data-quality monitoring of arriving order files
"""

__version__ = "0.1.0"
